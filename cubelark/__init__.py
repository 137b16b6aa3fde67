"""cubelark: segment analytics and corpus operators expressed as Spark plans."""

__version__ = "0.1.0"
