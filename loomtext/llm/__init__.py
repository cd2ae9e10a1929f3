"""Operators over whole text corpora. Nothing outside this subpackage imports it."""
