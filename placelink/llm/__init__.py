"""Training-data pipeline operators over document tables."""
