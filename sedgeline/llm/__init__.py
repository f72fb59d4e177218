"""Operators for preparing language-model training data.  Nothing else in sedgeline imports this subpackage."""
