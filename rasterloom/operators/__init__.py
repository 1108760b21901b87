"""Raster operators over pixel rows (y, x, v) and block rows (by, bx, ...)."""
