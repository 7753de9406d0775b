"""Training-data operators: dedup, packing, decontamination, cleaning, archives, token files."""
