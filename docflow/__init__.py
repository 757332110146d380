"""Document knowledge bases on Spark: chunk, index, retrieve, evaluate, observe."""
