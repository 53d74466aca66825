"""Point-in-time research operators on Spark."""
