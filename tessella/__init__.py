"""tessella: hybrid search over file corpora, and corpus preparation, on Spark DataFrames."""
