"""Analytics for document-shaped records on Spark: normalise, score, deduplicate, search and track."""
