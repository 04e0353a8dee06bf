"""DataFrame operators that derive one release table from others."""
