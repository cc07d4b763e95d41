"""Binary-score analytics on Spark DataFrames: typing, encoding, metrics, guarding, selection."""
