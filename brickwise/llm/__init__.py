"""Training-data operators: decontamination, deduplication, scans, classifiers and token counts."""
