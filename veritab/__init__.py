"""Dataset analysis on Spark: profiles, joins, tests, verdicts and insights as DataFrames."""
