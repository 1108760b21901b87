"""Channel names of mosaics, file numbers and text in descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .geometry import unique_names


def mosaic_names(mosaics: DataFrame, given: DataFrame) -> DataFrame:
    """(place, name): a name for each channel of mosaics (mosaic, channels), from names given (mosaic, names).

    mosaic counts from 0 on both sides. One name serves all channels of its mosaic, as many names as
    channels serve one each; otherwise the mosaic's number does. What is equal then is numbered."""
    both = mosaics.join(given, "mosaic", "full_outer").select("mosaic", F.coalesce("channels", F.lit(0)).alias("channels"), F.coalesce("names", F.array().cast("array<string>")).alias("names"))
    count = F.col("channels")
    fallback = F.array_repeat(F.concat(F.lit("Mosaic "), (F.col("mosaic") + 1).cast("string")), count)
    fits = F.when(F.size("names") == 1, F.array_repeat(F.get("names", F.lit(0)), count)).when(F.size("names") == count, F.col("names")).otherwise(fallback)
    each = both.select("mosaic", F.posexplode(fits).alias("k", "name"))
    place = F.row_number().over(Window.orderBy("mosaic", "k")) - 1  # channels of one job: a few hundred
    return unique_names(each.select(place.cast("int").alias("place"), "name"))


def numbered(place: str, name: str) -> Column:
    """ "07-name": a two-digit number, longer where it needs to be."""
    return F.concat(F.when(F.col(place) < 100, F.lpad(F.col(place).cast("string"), 2, "0")).otherwise(F.col(place).cast("string")), F.lit("-"), F.col(name))


def replaced(text: str, old: str, new: str) -> tuple[Column, Column]:
    """How often a piece of text occurs, and the text with it replaced."""
    whole = F.col(text)
    return ((F.length(whole) - F.length(F.replace(whole, F.lit(old), F.lit("")))) / len(old)).cast("int"), F.replace(whole, F.lit(old), F.lit(new))


def log_name(name: str, at: str) -> Column:
    """The name of a run's log: the configuration's name and the time it began."""
    return F.concat(F.col(name), F.lit("-run-"), F.date_format(F.col(at), "yyyyMMdd-HHmmss"), F.lit(".log"))


def glob_like(column: str, pattern: str) -> Column:
    """Whether a name matches a glob: * and ? stand for any characters but the folder sign, [...] for one of a set."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif end > 0:
            inner = pattern[i + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += "\\" + c if not c.isalnum() and c not in "_- " else c
        i += 1
    return F.col(column).rlike(f"^{out}$")
