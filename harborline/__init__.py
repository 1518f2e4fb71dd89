"""Labour-market style analytics and text operators on Spark DataFrames."""
