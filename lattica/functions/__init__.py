"""Driver-side statistics and records."""
