"""Training-data pipeline operators: thirteen corpus operators and their registered queries."""
