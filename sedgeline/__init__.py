"""Content analytics on Spark: relational lists, documents, merges, delta feeds and job state as DataFrames."""
