"""Operators for text and name data.  Nothing outside this subpackage imports it."""
