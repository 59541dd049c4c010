"""Entity types, pipelines and job planning."""
