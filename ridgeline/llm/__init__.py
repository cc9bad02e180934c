"""Training-data operators: tokenisation, sharding, near-duplicates, scoring, search and mixing.

Nothing else in the library imports this subpackage.  Operators live in one
module each; ``queries`` registers them.
"""
