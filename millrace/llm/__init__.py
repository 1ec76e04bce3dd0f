"""Operators that prepare text corpora for training; no other part of the library imports them."""
