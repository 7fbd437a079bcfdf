"""Change analytics for published documents, as Spark DataFrame jobs."""

__version__ = "0.1.0"
