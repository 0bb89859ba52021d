"""signals: portfolio scoring from noisy signal tables, written as Spark DataFrame plans."""

__version__ = "0.1.0"
