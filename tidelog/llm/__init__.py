"""Training-data operators: licences, tokenising, archives, filtering, search, dedup, scoring, sharding."""
