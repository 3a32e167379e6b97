"""Spark-native raster, shadow-geometry and elevation-change analytics."""
