"""Media and frame analytics, and training-data operators, on Spark."""
