"""rasterloom: a PySpark-native engine for aligning and analysing large tiled rasters."""
