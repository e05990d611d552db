"""Training-data operators: deduplication, decontamination, scrubbing, scanning, scoring, packing."""
