"""Call-audit analytics on Spark."""
