"""Operators that prepare text and entity records for training corpora. Nothing outside imports this subpackage."""
