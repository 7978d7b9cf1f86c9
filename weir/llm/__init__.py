"""Operators for large text corpora; nothing else in ``weir`` imports them."""
