"""Analytics over site content, links, keywords and usage, as Spark DataFrames."""
