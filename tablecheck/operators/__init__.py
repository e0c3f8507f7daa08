"""Checks as DataFrame jobs; each returns the violations, never a capped part of them."""
