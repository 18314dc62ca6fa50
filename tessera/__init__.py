"""tessera: RDF-style descriptions as Spark DataFrames.

Subject descriptions, triples and declarative view, table and search specifications are compiled to plain
Catalyst plans; data-quality operators for large corpora sit beside them.
"""

__version__ = "0.1.0"
