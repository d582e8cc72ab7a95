"""Text measurement on Spark: parsing, linkage, dictionary features, statistics and word vectors as DataFrames."""
