"""sources of the page-analytics engine."""
