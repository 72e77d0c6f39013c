"""inkveil: sensitive-data detection, redaction and corpus processing on Apache Spark."""

from inkveil.session import get_spark

__all__ = ["get_spark"]
