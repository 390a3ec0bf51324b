"""Sources, sinks and shared scratch space."""
