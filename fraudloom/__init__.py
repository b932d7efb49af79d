"""Identity-fraud analytics written as DataFrame-to-DataFrame operators on Spark."""
