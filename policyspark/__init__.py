"""policyspark: agreements to queryable policy tables, built on Spark DataFrames."""
