"""Operators for preparing training corpora. Nothing outside this folder imports it, and it imports nothing outside."""
