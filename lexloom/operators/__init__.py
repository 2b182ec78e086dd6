"""DataFrame operators: indexing, lookup, near-duplicate detection."""
