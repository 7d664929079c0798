"""millrace: a declarative data-integration engine whose plans compile to lazy PySpark DataFrames."""

__version__ = "0.1.0"
