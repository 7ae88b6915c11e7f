"""Training-data operators (de-duplication, tokens, scoring, mixing, privacy)."""
