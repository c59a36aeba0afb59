"""pressmill: a Spark-first engine for news ingestion, text analytics and corpus cleaning."""

__all__ = ["__version__"]
__version__ = "0.1.0"
