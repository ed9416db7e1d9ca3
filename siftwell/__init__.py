"""siftwell: evidence-gated retrieval and corpus processing as Spark plans."""

__version__ = "0.1.0"
