"""Operators for building training corpora; independent of the rest of the library."""
