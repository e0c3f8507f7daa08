"""Source files, loaded tables and the service's own append-only tables."""
