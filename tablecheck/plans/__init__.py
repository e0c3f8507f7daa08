"""From configuration to results: what to check, running it, rolling it up."""
