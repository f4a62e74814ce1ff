"""Column functions: hashed uniforms, split criteria, shared storage."""
