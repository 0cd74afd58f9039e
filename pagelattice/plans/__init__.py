"""plans of the page-analytics engine."""
