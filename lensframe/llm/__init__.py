"""Operators for text and vector collections; nothing outside this subpackage imports it."""
