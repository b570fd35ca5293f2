"""Page-structured documents on Spark: clean, order, chapter and segment text at corpus scale."""
