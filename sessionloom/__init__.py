"""sessionloom: session analytics and training-data preparation as Spark plans."""

__version__ = "0.2.0"
