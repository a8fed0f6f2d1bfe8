"""tessera: profiling, cleaning, feature engineering and classification of
tables as Spark DataFrame jobs."""

__version__ = "0.1.0"
