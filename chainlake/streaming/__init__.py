"""Part of chainlake: streaming."""
