"""Training-data operators: classification, deduplication, packing, extraction and filtering of large text corpora."""
