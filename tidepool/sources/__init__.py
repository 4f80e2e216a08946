"""Input scans, stage tables and saved-model artifacts."""
