"""lexloom: text indexing, term normalisation and near-duplicate detection on Spark."""
