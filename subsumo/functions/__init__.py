"""Column expressions: value text, bit words, dependency arrays."""
