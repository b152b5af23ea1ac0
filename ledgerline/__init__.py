"""A Spark-first engine for registers of declared interests and training-corpus tables."""
