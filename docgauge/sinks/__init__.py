"""Report and store writers."""
