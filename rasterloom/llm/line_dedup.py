"""Line deduplication by a deletion-neighbourhood join, in DataFrame operations only.

Lines are compared as words, whatever the blanks between them. Two lines are duplicates if
they are equal or, where both have at least `fuzzy_words` words, if one word inserted, deleted
or replaced makes them equal. A line is removed if an earlier line (by document id, then by its
place) is a duplicate of it, judged on the input; blank lines are never removed.

The deletion neighbourhood of a line is all variants with one word left out, as hashed keys.
Lines that meet in a key with the gap in the same place differ by a replacement; a variant that
equals a whole line differs from it by an insertion. So within a key the earliest line is
partner to all later ones, found by an aggregate and never by listing the key's pairs; the word
edit distance of each pair found is then verified on the lines themselves.

Before variants are made, coarser gaps decide who needs them and where: first half a line is
left out, then, of the halves whose other half somebody shares, an eighth of it at a time. One
edit lies within one such gap, so what nobody shares has no neighbour there. This drops no pair
and leaves variants to be made only for a few words of the lines that have near neighbours.

Defined results: null text stays null and has no lines; the empty text is one blank line;
repeated rows of one document are one document; rows with a null id stay as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

_PLACE = ("doc_id", "t", "line_no")
_WORDS = "octet_length(line) - octet_length(replace(line, ' ', '')) + 1"


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.hash("text").alias("t")).filter("doc_id is not null and text is not null")


def _untidy(text: Column) -> Column:
    """Whether some line has other blanks than single ones between words."""
    out = text.startswith(" ") | text.endswith(" ")
    for x in ("  ", " \n", "\n ", "\t", "\x0b", "\f", "\r"):
        out = out | text.contains(x)
    return out


def _tidy(line: Column, untidy: Column) -> Column:
    """The line with single blanks between words and none at the ends."""
    return F.when(untidy, F.trim(F.regexp_replace(line, r"[ \t\x0B\f\r]+", " "))).otherwise(line)


def _gap(length: str, p: str, q: str) -> str:
    """SQL for the key of a line as one of `length` words without its words p to q - 1."""
    return f"xxhash64({length}, {p}, {q}, substring_index(line, ' ', {p}), substring_index(line, ' ', {q} - ({length})))"


def _without(i: str) -> str:
    """SQL for the line without word i (from 0); the rest is joined by single blanks."""
    before, after = f"substring_index(line, ' ', {i})", f"substring_index(line, ' ', {i} + 1 - n)"
    return f"case when {i} = 0 then {after} when {i} = n - 1 then {before} else concat({before}, ' ', {after}) end"


def _shared(parts: DataFrame) -> DataFrame:
    """Of rows with key and role (0: a line of the key's length, 1: one a word longer), those
    that meet another line there: swap (two of the length), drop (longer) or whole."""
    counts = parts.groupBy("key").agg(F.sum(F.expr("int(role = 0)")).alias("owns"), F.sum("role").alias("longer")).filter("owns > 1 or (owns > 0 and longer > 0)")
    met = parts.join(counts, "key").withColumns({"swap": F.expr("role = 0 and owns > 1"), "whole": F.expr("role = 0 and longer > 0"), "drop": F.expr("role = 1 and owns > 0")})
    return met.filter("swap or whole or drop").drop("key", "owns", "longer")


def _fuzzy_lines(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """place, line, n and halves (role, late) of the lines that share half a line with another."""
    parts = distinct.filter("first.own is not null").select("first", F.explode(F.expr("""filter(array(
        named_struct('key', first.own[0], 'role', 0, 'late', true), named_struct('key', first.own[1], 'role', 0, 'late', false),
        named_struct('key', first.shorter[0], 'role', 1, 'late', true), named_struct('key', first.shorter[1], 'role', 1, 'late', false)), x -> x.key is not null)""")).alias("p"))  # fmt: skip
    parts = parts.select(*[F.col("first")[c].alias(c) for c in _PLACE], "p.*")
    needs = _shared(parts).groupBy("doc_id", "t", "line_no").agg(F.collect_set(F.struct("role", "late")).alias("halves"))
    by_doc = needs.groupBy("doc_id", "t").agg(F.map_from_entries(F.collect_list(F.struct("line_no", "halves"))).alias("needs"))
    asked = _texts(docs).dropDuplicates(["doc_id", "t"]).join(by_doc, ["doc_id", "t"])
    asked = asked.select("doc_id", "t", "needs", _untidy(F.col("text")).alias("untidy"), F.split("text", "\n").alias("lines"))  # once a document, below the explode
    asked = asked.select("doc_id", "t", "needs", "untidy", F.posexplode("lines").alias("line_no", "line"))
    asked = asked.select(*_PLACE, F.element_at("needs", F.col("line_no")).alias("halves"), _tidy(F.col("line"), F.col("untidy")).alias("line")).filter("halves is not null")
    return asked.withColumn("n", F.expr(_WORDS))


def _near_lines(asked: DataFrame) -> DataFrame:
    """The places of lines with an earlier line at one word's distance, from `_fuzzy_lines`."""
    # an eighth of a half left out
    eighths = asked.select(*_PLACE, F.explode(F.expr(f"""filter(flatten(transform(halves, h -> transform(sequence(0, 7), c ->
        named_struct('role', h.role, 'size', n - h.role, 'lo', if(h.late, (n - h.role) div 2, 0), 'hi', if(h.late, n - h.role, (n - h.role) div 2), 'c', c)))),
        x -> (x.hi - x.lo) * x.c div 8 < (x.hi - x.lo) * (x.c + 1) div 8)""")).alias("x"), "line")  # fmt: skip
    eighths = eighths.select(*_PLACE, "line", "x.role", "x.size", F.expr("int(x.lo + (x.hi - x.lo) * x.c div 8)").alias("p"), F.expr("int(x.lo + (x.hi - x.lo) * (x.c + 1) div 8)").alias("q"))
    eighths = eighths.select(*_PLACE, "role", "p", "q", F.expr(_gap("size", "p", "q")).alias("key"))
    gaps = _shared(eighths).groupBy(*_PLACE).agg(F.collect_set(F.struct("p", "q", "swap", "whole", "drop")).alias("gaps"))
    asked = stored(asked.drop("halves").join(gaps, list(_PLACE)))

    # the variants within those gaps: word i replaced, word i dropped, or the whole line
    variants = asked.select(*_PLACE, "n", F.explode(F.expr(f"""array_distinct(concat(
        flatten(transform(filter(gaps, g -> g.swap), g -> transform(sequence(g.p, g.q - 1), i -> named_struct('kind', 's', 'i', i,
            'key', xxhash64('s', n, i, substring_index(line, ' ', i), substring_index(line, ' ', i + 1 - n)))))),
        flatten(transform(filter(gaps, g -> g.drop), g -> transform(sequence(g.p, g.q), i -> named_struct('kind', 'd', 'i', i,
            'key', xxhash64('w', n - 1, {_without("i")}))))),
        if(exists(gaps, g -> g.whole), array(named_struct('kind', 'w', 'i', -1, 'key', xxhash64('w', n, line))), array())))""")).alias("v")).select(*_PLACE, "v.*")  # fmt: skip
    place = F.struct(*_PLACE)
    met = variants.groupBy("key").agg(
        F.min(F.when(F.col("kind") == "s", place)).alias("swap"), F.min(F.when(F.col("kind") == "d", F.struct(*_PLACE, "i"))).alias("long"),
        F.min(F.when(F.col("kind") == "w", place)).alias("short"), F.count(F.lit(1)).alias("size"),
    ).filter("size > 1")
    met = met.select("key", "swap", "short", F.expr("if(long is null, null, struct(long.doc_id, long.t, long.line_no))").alias("long"), F.col("long.i").alias("long_i"))
    found = variants.join(met, "key").withColumn("partner", F.expr("case kind when 's' then swap when 'd' then short else long end"))
    found = found.filter(F.col("partner") < place).select(*_PLACE, "kind", F.expr("if(kind = 'w', long_i, i)").alias("i"), "partner")
    found = found.groupBy(*_PLACE, "kind").agg(F.min(F.struct("partner", "i")).alias("m")).select(*_PLACE, "kind", "m.*")

    # the word edit distance of each pair, on the lines
    other = asked.select(F.struct(*_PLACE).alias("partner"), F.col("line").alias("other"))
    pairs = found.join(asked.select(*_PLACE, "line", "n"), list(_PLACE)).join(other, "partner")
    around = lambda x: f"struct(substring_index({x}, ' ', i), substring_index({x}, ' ', i + 1 - n))"
    longer = _without("i").replace("line", "other").replace("n - 1", "n").replace("1 - n", "- n")
    near = pairs.filter(F.expr(f"case kind when 's' then {around('line')} = {around('other')} when 'd' then {_without('i')} = other else {longer} = line end"))
    return near.select(*_PLACE).distinct()


def duplicate_lines(docs: DataFrame, fuzzy_words: int = 8) -> DataFrame:
    """(doc_id, t, line_no) of the lines to remove; t is hash(text), line_no counts from 0."""
    if fuzzy_words < 4:
        raise ValueError("one word in fewer than four says too little")
    lines = _texts(docs).select("doc_id", "t", _untidy(F.col("text")).alias("untidy"), F.split("text", "\n").alias("lines"))  # once a document, below the explode
    lines = lines.select("doc_id", "t", "untidy", F.posexplode("lines").alias("line_no", "line"))
    lines = lines.select(*_PLACE, _tidy(F.col("line"), F.col("untidy")).alias("line")).filter("line <> ''").withColumn("n", F.expr(_WORDS))
    halves = lambda length: F.array(F.expr(_gap(length, f"({length}) div 2", length)), F.expr(_gap(length, "0", f"({length}) div 2")))
    lines = stored(lines.select(
        *_PLACE, F.xxhash64("line").alias("h"), F.hash("line").alias("g"),
        F.when(F.col("n") >= fuzzy_words, halves("n")).alias("own"), F.when(F.col("n") > fuzzy_words, halves("n - 1")).alias("shorter"),
    ))
    distinct = lines.groupBy("h", "g").agg(F.min(F.struct(*_PLACE, "own", "shorter")).alias("first"))
    near = stored(_near_lines(stored(_fuzzy_lines(docs, distinct))))
    # who is first of its equals comes from an aggregate that combines before it shuffles, and the rest by
    # place, so that the copies of one line, however many, never meet under one key
    firsts = lines.groupBy("h", "g").agg(F.min(F.struct(*_PLACE)).alias("first")).select("first.*")
    return lines.select(*_PLACE).join(firsts, list(_PLACE), "left_anti").unionByName(near)


def _applied(docs: DataFrame, fuzzy_words: int) -> DataFrame:
    """row (all columns of docs), gone (places of the lines to remove, or null), kept_text."""
    gone = duplicate_lines(docs, fuzzy_words).groupBy("doc_id", "t").agg(F.collect_set("line_no").alias("gone"))
    rows = docs.select("doc_id", F.hash("text").alias("t"), F.struct(*docs.columns).alias("row")).join(gone, ["doc_id", "t"], "left")
    kept = F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains("gone", i))
    return rows.withColumn("kept_text", F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n")))


def line_report(docs: DataFrame, fuzzy_words: int = 8) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, kept_sha256 of the lines left."""
    rows = _applied(docs.select("doc_id", "text"), fuzzy_words)
    lines = F.when(F.col("row.text").isNull(), 0).otherwise(F.expr("octet_length(row.text) - octet_length(replace(row.text, '\\n', '')) + 1"))
    return rows.select("doc_id", lines.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def remove_duplicate_lines(docs: DataFrame, fuzzy_words: int = 8) -> DataFrame:
    """The documents without their duplicate lines, all columns kept.

    A document whose every line is a duplicate has nothing of its own left and goes; one that
    was blank from the start stays."""
    rows = _applied(docs, fuzzy_words).filter("gone is null or trim(translate(kept_text, '\\n\\t\\r', '   ')) <> ''")
    return rows.select(*[F.col("row")[c].alias(c) if c != "text" else F.col("kept_text").alias("text") for c in docs.columns])
