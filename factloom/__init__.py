"""factloom: an evidence-analytics engine expressed as PySpark DataFrame plans."""

from factloom.session import session

__all__ = ["session"]
