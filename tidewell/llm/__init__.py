"""Operators for preparing large text corpora: dedup, scoring, mixing, tokens.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames, names its key and text columns as parameters, and defines in
its docstring what nulls, empty texts, ties and repeated rows give.
"""
