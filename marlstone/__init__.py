"""Marlstone: retrieval, knowledge-base and corpus analytics written as Spark DataFrame operators."""

__version__ = "0.1.0"
