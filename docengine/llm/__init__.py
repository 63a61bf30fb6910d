"""Training-data operators: URL filters, quality rules, language id, deduplication, formatting, tokenising, archives."""
