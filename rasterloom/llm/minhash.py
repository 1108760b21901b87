"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document is its set of distinct word shingles. Two fixed permutations of a small universe
give all signature coordinates: the first spreads the shingles, the second is read at a
circular shift of k for coordinate k, so one shingle adds to every coordinate through one
contiguous slice of a table. Bands of `rows` coordinates bucket the sets; links are only ever
made by the exact Jaccard similarity of the full sets.

Copies of one set are collapsed to their smallest id before anything else. A bucket is joined
to its smallest member first (a star, not all pairs), behind filters on set size and on a sketch
of the signature. Members that this leaves outside the component of the bucket's smallest, the
base, are gathered for each base over all buckets and compared with each other and with the
base's members by the exact similarity, in tiles of two blocks: nothing is listed pair by pair,
and a tile gives back only links that join two components. So no link between components is lost
and a group of copies never becomes all its pairs. The star's sketch filter lies five standard
deviations under the threshold; with 32 bands of 4 rows a pair at similarity 0.8 shares no
bucket with a chance of 5e-8.

Defined results: null, empty and blank texts have no shingles and are linked with nothing; a
text with fewer words than a shingle is one shingle; rows that share an id are one node; a row
with a null id is linked with nothing and is its own null component; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, checkpointed, components, mixed, signed, spans, text_slices

UNIVERSE = 1 << 18
BANDS, ROWS = 32, 4
#: Of 128 two-bit codes, so many agree at least; at similarity 0.8 the mean is 108.8, the deviation 4.
AGREE = 88
#: About how many documents and shingles one block of a tile holds, and into how many parts a hot base is dealt.
BLOCK_ROWS, BLOCK_SHINGLES, SALTS = 1024, 300_000, 16


def shingle_sets(w: Words, words: int) -> list[np.ndarray]:
    """The distinct shingles of each document, hashed and sorted."""
    grams = w.grams(words)
    out = []
    for lo, hi in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if hi - lo >= words:
            out.append(np.unique(grams[lo : hi - words + 1]))
        elif hi > lo:
            whole = (w.code[lo:hi] * mixed(np.arange(1, hi - lo + 1, dtype=U64))).sum(dtype=U64, keepdims=True)
            out.append(mixed(whole + U64(hi - lo)))
        else:
            out.append(np.zeros(0, dtype=U64))
    return out


class Circulant:
    """Signatures from two permutations of the universe, the second circularly shifted."""

    def __init__(self, coordinates: int, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.spread = rng.permutation(UNIVERSE)
        shifted = rng.permutation(UNIVERSE).astype(np.int32)
        ring = np.concatenate([shifted, shifted[:coordinates]])
        self.slices = np.lib.stride_tricks.sliding_window_view(ring, coordinates)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        at = self.spread[(shingles & U64(UNIVERSE - 1)).astype(np.int64)]
        low = self.slices[at[:2048]].min(axis=0)
        for k in range(2048, len(at), 2048):
            low = np.minimum(low, self.slices[at[k : k + 2048]].min(axis=0))
        return low


def _sketch(signature: np.ndarray) -> np.ndarray:
    """Two bits of each of 128 coordinates, the first bits in words 0 and 1, the second in 2 and 3."""
    code = mixed(signature[:128].astype(U64))
    bits = np.concatenate([code & U64(1), (code >> U64(1)) & U64(1)]).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def _sign(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = Circulant(bands * rows)
        salt = mixed(np.arange(1, bands + 1, dtype=U64))
        for b in batches:
            for at, to, buf, offsets in text_slices(b.column(1)):
                sets = shingle_sets(Words(buf, offsets, lower=True), words)
                n, s1, s2, keys, sketch = [], [], [], [], []
                for s in sets:
                    n.append(len(s))
                    s1.append(mixed(s).sum(dtype=U64))
                    s2.append(mixed(s ^ U64(0x5DEECE66D)).sum(dtype=U64))
                    if len(s):
                        sig = hashing.signature(s)
                        code = salt.copy()
                        for c in sig.reshape(bands, rows).T.astype(U64):
                            code = mixed(code * U64(1099511628211) + c)
                        keys.append(signed(code))
                        sketch.append(_sketch(sig))
                    else:
                        keys.append([])
                        sketch.append([])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[at:to], pa.array(n, pa.int64()), pa.array(signed(np.array(s1, dtype=U64))), pa.array(signed(np.array(s2, dtype=U64))), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "s1", "s2", "bands", "sketch"],
                )

    return run


def _verified(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            right = shingle_cache(words)
            keep = []
            for at, to, buf, offsets in text_slices(b.column(2)):
                left = shingle_sets(Words(buf, offsets, lower=True), words)
                for i in range(at, to):
                    x, y = left[i - at], right(b.column(1)[i].as_py(), b.column(3)[i])
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in b.columns[:2]], names=["a", "b"])

    return run


def shingle_cache(words: int):
    """The set of a text, kept from one call to the next while the id stays the same."""
    held: list = [None, None, None]

    def of(key: int, text: pa.Scalar) -> np.ndarray:
        raw = text.as_buffer()
        if held[0] != key or held[1] != raw.size:
            buf = np.frombuffer(raw, dtype=np.uint8) if raw.size else np.zeros(0, dtype=np.uint8)
            held[:] = [key, raw.size, shingle_sets(Words(buf, np.array([0, len(buf)]), lower=True), words)[0]]
        return held[2]

    return of


def _links(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Of pairs (a, b), b the smaller id, those whose full sets are similar enough."""
    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(_verified(words, percent), "a long, b long").distinct()


def _close(x: str, y: str, percent: int) -> str:
    differ = " + ".join(f"bit_count(({x}.sketch[{i}] ^ {y}.sketch[{i}]) | ({x}.sketch[{i + 2}] ^ {y}.sketch[{i + 2}]))" for i in (0, 1))
    sizes = f"100 * least({x}.n_shingles, {y}.n_shingles) >= {percent} * greatest({x}.n_shingles, {y}.n_shingles)"
    return f"{sizes} and 128 - ({differ}) >= {AGREE if percent >= 80 else 0}"


def _meet(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set.

    Shingles that many sets of both sides hold are counted by matrix product, the others by
    listing who holds them, both in slices of bounded size."""
    both = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    sides = []
    for sets in (left, right):
        of, shingle = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
        at = np.minimum(np.searchsorted(both, shingle), max(len(both) - 1, 0))
        here = both[at] == shingle if len(both) else np.zeros(len(shingle), dtype=bool)
        order = np.argsort(at[here], kind="stable")
        holder = of[here][order]
        n = np.bincount(at[here], minlength=len(both))
        sides.append((holder, np.cumsum(n) - n, n))
    (hl, fl, nl), (hr, fr, nr) = sides
    out = np.zeros(len(left) * len(right), dtype=np.float32)
    often = nl * nr * 64 > len(left) * len(right)
    dense = np.flatnonzero(often)
    table_ = out.reshape(len(left), len(right))
    for k in range(0, len(dense), 2048):
        some = dense[k : k + 2048]
        x, y = (np.zeros((len(sets), len(some)), dtype=np.float32) for sets in (left, right))
        x[hl[spans(fl[some], nl[some])], np.repeat(np.arange(len(some)), nl[some])] = 1
        y[hr[spans(fr[some], nr[some])], np.repeat(np.arange(len(some)), nr[some])] = 1
        table_ += x @ y.T
    rare = np.flatnonzero(~often)
    cut = np.flatnonzero(np.diff(np.cumsum(nl[rare] * nr[rare]) >> 21)) + 1
    for some in np.split(rare, cut):
        holders = spans(fl[some], nl[some])
        times = np.repeat(nr[some], nl[some])
        pair = np.repeat(hl[holders], times) * len(right) + hr[spans(np.repeat(fr[some], nl[some]), times)]
        which, n = np.unique(pair, return_counts=True)
        out[which] += n
    return table_


def _tile(words: int, percent: int):
    """Links between the components of one tile, of those that say the same only the first."""

    def run(rows: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        text = pa.concat_arrays(rows.column("text").chunks)
        sets = []
        for _, _, buf, offsets in text_slices(text):
            sets += shingle_sets(Words(buf, offsets, lower=True), words)
        ids, component, is_left = (rows.column(c).to_numpy() for c in ("doc_id", "component", "is_left"))
        size = np.array([len(x) for x in sets], dtype=np.int64)
        rights = np.flatnonzero(~is_left)
        lefts = np.flatnonzero(is_left)
        if not len(rights):
            rights = lefts
        step = max(1, (1 << 22) // max(1, len(rights)))
        parent: dict[int, int] = {}

        def top(c: int) -> int:
            while parent.setdefault(c, c) != c:
                c = parent[c]
            return c

        for k in range(0, len(lefts), step):
            mine = lefts[k : k + step]
            common = _meet([sets[i] for i in mine], [sets[i] for i in rights]).astype(np.int64)
            union = size[mine][:, None] + size[rights][None, :] - common
            i, j = np.nonzero((100 * common >= percent * union) & (common > 0) & (component[mine][:, None] != component[rights][None, :]))
            i, j = mine[i], rights[j]
            _, one = np.unique(np.stack([component[i], component[j]]), axis=1, return_index=True)
            for x, y in zip(i[one].tolist(), j[one].tolist()):
                p, q = top(int(component[x])), top(int(component[y]))
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    found.append((int(ids[x]), int(ids[y])))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


def _settled(near: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) that join the components met in open buckets.

    near: doc_id, component, n_shingles and base, the component of a bucket's smallest member.
    All that met one base are its outsiders. Outsiders are held against each other and against the
    base's own members, in tiles of two blocks. A document comes once for each tile, not once for
    each partner or bucket, and a tile holds about BLOCK_SHINGLES and BLOCK_ROWS twice at most."""
    outside = F.col("component") != F.col("base")

    def blocks(which) -> F.Column:
        rows, total = F.sum(F.when(which, 1).otherwise(0)), F.sum(F.when(which, F.col("n_shingles")).otherwise(0))
        return F.ceil(F.greatest(F.lit(1.0), rows / BLOCK_ROWS, total / BLOCK_SHINGLES)).cast("int")

    sizes = near.groupBy("base").agg(blocks(outside).alias("s"), blocks(~outside).alias("m"))
    sizes = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = near.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SALTS)).cast("int")).join(sizes, ["base", "salt"])
    dealt = dealt.withColumn("at", F.pmod(F.xxhash64("doc_id"), F.when(outside, F.col("s")).otherwise(F.col("m"))).cast("int"))
    places = F.expr("""case when component = base then transform(sequence(0, s - 1), k -> named_struct('i', k, 'inner', true, 'j', at, 'is_left', false))
        else concat(transform(sequence(at, s - 1), k -> named_struct('i', at, 'inner', false, 'j', k, 'is_left', true)),
                    transform(sequence(0, m - 1), k -> named_struct('i', at, 'inner', true, 'j', k, 'is_left', true)),
                    transform(filter(sequence(0, s - 1), k -> k < at), k -> named_struct('i', k, 'inner', false, 'j', at, 'is_left', false))) end""")
    tiles = dealt.join(texts.select("doc_id", "text"), "doc_id").select("base", "doc_id", "component", "text", F.explode(places).alias("p")).select("base", "p.*", "doc_id", "component", "text")
    return tiles.groupBy("base", "i", "inner", "j").applyInArrow(_tile(words, percent), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 2, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked where 100 * intersection >= percent * union of their shingle sets."""
    texts = docs.select("doc_id", "text")
    signs = checkpointed(texts.withColumn("text", F.coalesce("text", F.lit(""))).mapInArrow(_sign(words, BANDS, ROWS), "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, sketch array<long>"))
    full = signs.filter("n_shingles > 0 and doc_id is not null")
    copies = full.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    chosen = full.join(copies.select("s1", "s2", F.col("rep").alias("doc_id")), ["s1", "s2", "doc_id"], "left_semi")
    brief = chosen.select("doc_id", "n_shingles", "sketch")
    banded = chosen.select("doc_id", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("key", "low")
    members = checkpointed(banded.join(buckets, "key"))
    stars = members.filter("doc_id <> low").select(F.col("doc_id").alias("a"), F.col("low").alias("b")).distinct()
    x, y = brief.withColumnRenamed("doc_id", "a").alias("x"), brief.withColumnRenamed("doc_id", "b").alias("y")
    stars = stars.join(x, "a").join(y, "b").filter(_close("x", "y", percent)).select("a", "b")
    rep_texts = texts.filter("doc_id is not null and text is not null")
    first = checkpointed(_links(stars, rep_texts, words, percent))
    labels = components(first)

    # what the stars leave open: members of another component than their bucket's smallest
    label = labels.withColumnRenamed("node", "doc_id")
    held = members.join(label, "doc_id", "left").select("key", "doc_id", "low", F.coalesce("component", "doc_id").alias("component"))
    base = held.filter("doc_id = low").select("key", F.col("component").alias("base")).distinct()
    held = held.select("key", "doc_id", "component").join(base, "key")
    open_keys = held.filter("component <> base").select("key").distinct()
    near = held.join(open_keys, "key", "left_semi").select("base", "doc_id", "component").distinct()
    second = _settled(checkpointed(near.join(brief.select("doc_id", "n_shingles"), "doc_id")), rep_texts, words, percent)

    shared = full.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("doc_id")
    same_id = full.join(shared, "doc_id", "left_semi").join(copies, ["s1", "s2", "n_shingles"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    edges = labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(second).union(same_id).filter("a <> b")
    final = components(edges)
    of_rep = final.select(F.col("node").alias("rep"), "component")
    out = signs.select("doc_id", "n_shingles", "s1", "s2").join(copies.join(of_rep, "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component")), ["s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.expr("doc_id <=> component_id"))


def keep_one_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents of which no smaller id is in the same component, with all their columns.

    Rows that share an id are one node and stay or go together; rows with a null id stay."""
    gone = near_duplicates(docs, words, percent).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
