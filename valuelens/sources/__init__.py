"""Sources, sinks and dataset management."""
