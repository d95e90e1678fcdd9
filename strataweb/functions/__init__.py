"""Column functions: URLs, patterns, HTTP headers."""
