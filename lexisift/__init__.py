"""lexisift: a Spark-native text corpus engine (segmentation, quality, dedup, n-gram models)."""
