"""Kept for streams; nothing in scope is one, so nothing is here."""
