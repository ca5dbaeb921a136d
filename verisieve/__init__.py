"""Analytics over verifiable model interactions, expressed as Spark plans."""

__version__ = "0.1.0"
