"""Training-data operators: filtering, formatting, de-duplication, search, tokenization, packing."""
