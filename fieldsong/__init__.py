"""Acoustic-event analytics on Spark: recordings, annotations, detections and reviews as DataFrames."""

__version__ = "0.1.0"
