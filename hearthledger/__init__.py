"""hearthledger: household-finance analytics and corpus processing on Spark DataFrames."""
