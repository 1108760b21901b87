"""Where rasters are written."""
