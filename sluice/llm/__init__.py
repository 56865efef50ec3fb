"""Operators that prepare text, pages, vectors and media for model training.

Each module holds one operator with a general interface; ``queries`` holds the
thin ``opN_<name>`` queries over the standard tables.
"""
