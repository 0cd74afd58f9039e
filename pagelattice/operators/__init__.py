"""operators of the page-analytics engine."""
