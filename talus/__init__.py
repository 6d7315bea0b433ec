"""talus: batch and streaming analytics for transaction-risk data on Spark DataFrames."""
