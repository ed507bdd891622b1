"""Part of chainlake: operators."""
