"""Tidewire: a Spark-first analytics engine for streams of text documents and the events they mention."""

__version__ = "0.1.0"
