"""Training-data pipeline operators: decontamination, secrets, token counts, sharding, language-model
scores, web archives, packing, near-duplicate joins, quality ranking and vector search."""
