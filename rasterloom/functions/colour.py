"""Stain and ink intensities of RGB pixels, as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Stain vectors (red, green, blue) of haematoxylin with AEC, and with DAB.
HAX = ((0.650, 0.704, 0.286), (0.2743, 0.6796, 0.6803))
HDX = ((0.650, 0.704, 0.286), (0.268, 0.570, 0.776))


def luma(r: str = "r", g: str = "g", b: str = "b") -> Column:
    return F.rint(0.299 * F.col(r) + 0.587 * F.col(g) + 0.114 * F.col(b)).cast("int")


def marker_ink(r: str = "r", g: str = "g", b: str = "b") -> Column:
    """Magenta plus yellow of the CMYK colour; black has none."""
    c, m, y = (1 - F.col(k) / F.lit(255.0) for k in (r, g, b))
    k = F.least(c, m, y)
    return F.coalesce(F.try_divide(m - k, 1 - k) + F.try_divide(y - k, 1 - k), F.lit(0.0))


def unmixing(stains: tuple = HAX) -> np.ndarray:
    """The inverse of the stain matrix; the third stain is perpendicular to the two given."""
    rows = [np.array(s) for s in stains]
    return np.linalg.inv(np.array([*rows, np.cross(*rows)]))


def stain(which: int, stains: tuple = HAX) -> Column:
    """The amount of one stain in optical density, not under 0."""
    weights = unmixing(stains)[:, which]
    floor = 1e-6
    density = [F.log(F.greatest(F.col(k) / F.lit(255.0), F.lit(floor))) / F.lit(float(np.log(floor))) for k in "rgb"]
    return F.greatest(sum((d * F.lit(float(w)) for d, w in zip(density, weights)), F.lit(0.0)), F.lit(0.0))


def flow_lab(dy: str, dx: str, radius: float) -> tuple[Column, Column, Column]:
    """A shift as a colour: a from dx, b from dy, lightness from their size; no shift is black."""
    y, x = F.coalesce(F.col(dy).cast("double"), F.lit(0.0)), F.coalesce(F.col(dx).cast("double"), F.lit(0.0))
    scale = F.greatest(F.sqrt(y * y + x * x), F.lit(float(radius)))
    a, b = x / scale, y / scale
    return F.sqrt(a * a + b * b) * 50, a * 100, b * 100


def cmyk(r: str = "r", g: str = "g", b: str = "b") -> list[Column]:
    """Cyan, magenta, yellow and black from 0 to 1; black has no colour."""
    own = [1 - F.col(k) / F.lit(255.0) for k in (r, g, b)]
    black = F.least(*own)
    return [*[F.coalesce(F.try_divide(c - black, 1 - black), F.lit(0.0)) for c in own], black]


def processed(mode: str) -> Column:
    """The intensity of a mode before neighbourhoods: what is stained, or how dark it is."""
    modes = {"grayscale": lambda: luma().cast("double"), "hematoxylin": lambda: stain(0), "dab": lambda: stain(1, HDX), "aec": marker_ink}
    if mode not in modes:
        raise ValueError(f"no colour mode {mode!r}")
    return modes[mode]()
