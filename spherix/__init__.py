"""Analytics for data on a sphere, on Spark."""
