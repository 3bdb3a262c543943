"""Web-page analytics on Spark."""
