"""Training-data operators: token counts, quality, duplicates, secrets, licences, packing."""
