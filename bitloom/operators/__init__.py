"""Relational operators over tensors, matrices and bit rows."""
