"""Session-level helpers: table access and durable intermediate tables."""
