"""mixtura: statistical learning and data preparation on Spark DataFrames."""
