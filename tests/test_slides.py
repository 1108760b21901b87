"""Slide lists and pixel sizes."""

from rasterloom import catalogue
from rasterloom.sources import slides


def test_slide_list(spark):
    rows = sorted(catalogue.queries()["slide_list"](spark, "").collect())
    assert [r.channel for r in rows] == ["Hem-C01R3", "PD1-C01R1", "PDL1-C01R2", "CD4-C02R1", "CD3-C03R1", "DCLAMP-C03R3", "CD8-C04R1"]
    assert [r.mode for r in rows] == ["hematoxylin"] + ["aec"] * 6


def test_pixel_sizes(spark):
    xml = [("a", '<Pixels PhysicalSizeX="0.65" PhysicalSizeXUnit="µm"/>'), ("b", '<Pixels PhysicalSizeX="650" PhysicalSizeXUnit="nm"/>'), ("c", '<Pixels PhysicalSizeX="0.5"/>'), ("d", "<Pixels/>"), ("e", None), ("f", '<Pixels PhysicalSizeX="3" PhysicalSizeXUnit="pixel"/>')]
    got = {r.slide: round(r.pixel_size, 9) for r in slides.pixel_sizes(spark.createDataFrame(xml, "slide string, xml string")).collect()}
    assert got == {"a": 0.65, "b": 0.65, "c": 0.5, "d": 1.0, "e": 1.0, "f": 1.0}
