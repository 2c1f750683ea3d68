"""Record timelines, result evidence and serving views as Spark DataFrame transforms."""

__version__ = "0.1.0"
