"""Operators on graphs of records and on texts. Nothing outside this subpackage imports it."""
