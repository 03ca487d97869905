"""gridlore: energy time series, the documents that explain them, and training corpora, as Spark DataFrames."""
