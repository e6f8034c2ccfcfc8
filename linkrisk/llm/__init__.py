"""Training-data pipeline operators (one module per operator) and their queries."""
