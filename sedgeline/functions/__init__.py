"""Subpackage of sedgeline."""
