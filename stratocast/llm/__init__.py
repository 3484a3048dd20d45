"""Training-data operators: search, dedup, rules, packing, extraction, scoring, mixing and token files."""
