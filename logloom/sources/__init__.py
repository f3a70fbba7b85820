"""Raw log files and stored tables."""
