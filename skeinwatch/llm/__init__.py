"""Training-data operators: language, tokens, search, duplicates, secrets, URLs, packing, mixing, chat."""
