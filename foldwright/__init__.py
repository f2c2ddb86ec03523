"""foldwright: automated tabular-ML studies expressed as Spark DataFrame jobs."""

__version__ = "0.1.0"
