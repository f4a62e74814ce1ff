"""Operators of forest training, prediction and validation."""
