"""veilscore — tabular preparation, integer linear scoring (plain and sealed),
and rare-event evaluation, expressed as Spark DataFrame jobs."""

__version__ = "0.1.0"
