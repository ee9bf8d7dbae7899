"""Linear models with many high-cardinality group effects, on DataFrames."""
