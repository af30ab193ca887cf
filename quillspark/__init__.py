"""quillspark: a Spark-first analytics engine for evidence pipelines over document corpora."""

__version__ = "0.1.0"
