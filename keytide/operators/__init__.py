"""Relational operators over logs of key mutations."""
