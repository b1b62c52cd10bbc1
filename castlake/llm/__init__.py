"""Training-data operators: scoring, search, sharding and encoding of text corpora on Spark."""
