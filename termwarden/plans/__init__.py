"""Releases, the checks over them and their reports."""
