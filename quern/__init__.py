"""quern: a Spark-first engine for preparing and analysing speech and text corpora."""

__version__ = "0.1.0"
