"""Training-data operators: chat formatting, scoring, filtering, near-duplicate search, encoding."""
