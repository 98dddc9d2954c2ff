"""Part of the trajectory and event engine."""
