"""Invoice-text analytics on Spark: text to lines, blocks, records, clean tables."""
