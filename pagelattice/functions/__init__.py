"""functions of the page-analytics engine."""
