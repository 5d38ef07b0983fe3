"""tessera: geometric, relational and corpus analytics expressed as Spark plans."""

__version__ = "0.2.0"
