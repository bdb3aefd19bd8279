"""Spark-native analytics over catalogues of narrowband detections."""
