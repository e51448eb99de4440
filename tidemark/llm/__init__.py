"""Training-data operators: dedup, scoring, media, mixing, token files, search, PII, licences, packing."""
