"""Travel-time fields and weighted centre of gravity over street networks, on Spark DataFrames."""
