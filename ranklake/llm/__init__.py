"""Operators for preparing texts and records for language models; nothing else in the library imports them."""
