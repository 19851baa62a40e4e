"""Multi-level discovery runs."""
