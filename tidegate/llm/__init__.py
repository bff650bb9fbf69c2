"""Operators for text corpora and records about people. Nothing outside of this subpackage imports it."""
