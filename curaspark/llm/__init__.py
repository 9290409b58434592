"""Training-data operators: formatting, privacy, secrets, near duplicates, tokens, scores and quality."""
