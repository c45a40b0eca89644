"""itemlake: assessment items at corpus scale, expressed as Spark DataFrame jobs."""

__version__ = "0.1.0"
