"""DataFrame -> DataFrame operators over the care tables and the outcome mart."""
