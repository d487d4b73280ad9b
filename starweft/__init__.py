"""Starweft: a PySpark-native engine that links point detections of moving objects, with data-pipeline operators."""
