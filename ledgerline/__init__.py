"""ledgerline: usage-ledger analytics on Spark DataFrames."""
