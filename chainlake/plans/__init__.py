"""Part of chainlake: plans."""
