"""Day-by-day comparison of two text corpora as Spark DataFrame jobs."""
