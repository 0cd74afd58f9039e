"""streaming of the page-analytics engine."""
