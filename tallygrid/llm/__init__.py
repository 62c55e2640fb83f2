"""Training-data pipeline operators: one module per operator, each with a general interface and a registered query."""
