"""Recognition-evaluation and corpus-audit operators on Spark."""
