"""datakiln: dataset curation and evaluation on Spark DataFrames."""
