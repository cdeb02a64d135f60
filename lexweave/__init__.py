"""lexweave: document-network analytics and training-data preparation on Spark."""
