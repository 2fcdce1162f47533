"""Analytics of equipment sensor streams, and of the documents that explain them, on Spark."""
