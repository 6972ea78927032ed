"""Operators for building training corpora: one module for each, registered in `queries`."""
