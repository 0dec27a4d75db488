"""Operators for building training corpora: each module holds one of them, ``queries`` registers them."""
