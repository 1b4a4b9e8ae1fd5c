"""Training-data operators: dedup, extraction, mixing, packing, filters, scans."""
