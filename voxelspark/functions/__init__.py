"""Column expressions: bits, hashes, geometry, colours, scalars."""
