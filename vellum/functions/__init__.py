"""Column builders: text, JSON, arithmetic, hashes."""
