"""Part of chainlake: sources."""
