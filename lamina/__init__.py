"""lamina: layered documents as Spark tables, and the operators that work on them."""

__version__ = "0.1.0"
