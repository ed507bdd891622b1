"""Part of chainlake: functions."""
