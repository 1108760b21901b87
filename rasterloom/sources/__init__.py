"""Sources: rasters as pixel rows."""
