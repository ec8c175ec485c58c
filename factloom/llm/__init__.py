"""Training-corpus operators: quality, tokenisation, deduplication, mixing, scoring and sanitising."""
