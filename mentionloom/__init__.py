"""mentionloom: entity linking and knowledge-base analytics on Spark DataFrames."""
