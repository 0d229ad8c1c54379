"""Continuous evaluation: an extra, as the studied work has no streams."""
