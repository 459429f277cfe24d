"""Spark-native analytics over large archives of seismic measurements."""
