"""Training-data operators.

Self-contained: nothing in the rest of the library imports this subpackage, and
it only borrows Spark, numpy, pyarrow and the tokenizers library.  ``queries``
holds the registered queries and ``oracles`` their SQL.
"""
