"""Frames in, encoded tables out."""
