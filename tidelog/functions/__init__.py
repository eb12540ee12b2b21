"""Column functions of the log format."""
