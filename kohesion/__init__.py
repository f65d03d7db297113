"""Clustering validation on Spark: which clustering of a table of features is stable, and does it generalise?"""

__version__ = "0.1.0"
