"""Operators for preparing training corpora. Nothing else in docveil imports this subpackage."""
