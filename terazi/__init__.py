"""terazi: fund-panel analytics and data preparation on Spark DataFrames."""
