"""Column expressions over findings: text, hashes, vocabularies, micro-syntax."""
