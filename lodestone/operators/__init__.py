"""DataFrame -> DataFrame operators: cleaning, chunking, retrieval, enrichment, state, evaluation."""
