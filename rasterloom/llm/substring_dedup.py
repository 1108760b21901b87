"""Removal of passages that an earlier document already has, by relative Lempel-Ziv parsing.

The reference that a document is parsed against is every document of a smaller id. It is cut
into blocks by content: each window of `window` words is led by the smallest hash among its
word groups of `gram` words, and the successive windows with one leader form a block. Equal
windows have equal leaders wherever they stand, so blocks of equal content meet in one key of
a distributed index, and the index is never gathered anywhere.

A document is then factored from left to right. Where a block's content is indexed for an earlier
document, all its windows match there; where contents share a leader but differ, which is at the
boundaries of such matches, the windows are looked up one by one, each for the earliest document
with that window. From the first word that matches, the factor is extended as long as what
follows matches the same reference at the next place; where it ends, the next factor begins with the
next window that matches, so windows across a factor's boundary count too. A factor (start, length,
reference document, start there) is at least one window long, and the words that factors cover
are the duplicate spans.

Defined results: null and empty texts have no words and lose nothing; a null id never counts
as earlier and such a row loses nothing; repeated rows of one id are not earlier than each
other; other columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, mixed, signed, spans, text_slices

_RUNS = "doc_id long, t int, start int, n int, leader long, content long"


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    out, have = x, 1
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(x) - width + 1], out[width - have : len(x) - have + 1])
    return out


def _contents(windows: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A block's content: its first and last window and their number, which cover all its words."""
    return mixed(windows[at] * U64(3) + mixed(windows[at + n - 1] + n.astype(U64)))


def _blocks_of(w: Words, window: int, gram: int):
    """(document, first window, number of windows, leader, content) of all blocks, as arrays."""
    if len(w.code) < window:
        return None
    lead = _sliding_min(w.grams(gram), window - gram + 1)
    windows = w.grams(window)
    size = np.diff(w.first)
    doc_of = np.repeat(np.arange(len(size)), size)
    at = np.flatnonzero(doc_of[: len(windows)] == doc_of[window - 1 :])
    if len(at) == 0:
        return None
    led = lead[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (led[1:] != led[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    length = np.diff(np.append(head, len(at)))
    most = window - gram + 1
    if length.max() > most:  # periodic text: one leader again and again
        parts = -(-length // most)
        head = np.repeat(head, parts) + spans(np.zeros(len(parts), dtype=np.int64), parts) * most
        length = np.diff(np.append(head, len(at)))
    first = at[head]
    doc = doc_of[first]
    return doc, first - w.first[doc], length, led[head], _contents(windows, first, length)


def _blocks(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, t = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            for at, to, buf, offsets in text_slices(b.column(1)):
                found = _blocks_of(Words(buf, offsets), window, gram)
                if found is not None:
                    doc, start, n, leader, content = found
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[at:to][doc]), pa.array(t[at:to][doc]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(signed(leader)), pa.array(signed(content))],
                        names=["doc_id", "t", "start", "n", "leader", "content"],
                    )

    return run


def _windows(window: int):
    """The windows of listed blocks: (window, doc_id, pos, content, k)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, starts, ns, contents = (b.column(i) for i in (0, 2, 3, 4))
            ids = ids.to_numpy(zero_copy_only=False)
            for at, to, buf, offsets in text_slices(b.column(1)):
                w = Words(buf, offsets)
                every = w.grams(window)
                lists = [np.concatenate([x[i].values.to_numpy(zero_copy_only=False) for i in range(at, to)]) for x in (starts, ns, contents)]
                doc = np.repeat(np.arange(to - at), [len(starts[i]) for i in range(at, to)])
                start, n, content = lists
                first = w.first[doc] + start
                own = first + n + window - 1 <= w.first[doc + 1]  # rows may share an id, not a text
                own[own] = signed(_contents(every, first[own], n[own])) == content[own]
                doc, first, n, content = doc[own], first[own], n[own], content[own]
                pos = spans(first, n)
                inside = pos - np.repeat(w.first[doc], n)
                k = spans(np.zeros(len(n), dtype=np.int64), n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(every[pos])), pa.array(np.repeat(ids[at:to][doc], n)), pa.array(inside.astype(np.int32)), pa.array(np.repeat(content, n)), pa.array(k.astype(np.int32))],
                    names=["window", "doc_id", "pos", "content", "k"],
                )

    return run


def parse(start: np.ndarray, length: np.ndarray, ref_doc: np.ndarray, ref_start: np.ndarray, window: int) -> np.ndarray:
    """(start, length, ref_doc, ref_start) of the greedy factors of a document with these matches.

    A match of l words is l - window + 1 matching windows in a row. A factor takes each match whose
    next window lies at the same distance in the same reference, and ends where none does."""
    order = np.lexsort((-length, start))
    out: list[list[int]] = []
    last = -1  # the last window start that is covered by a factor
    for s, n, d, r in zip(*(c[order].tolist() for c in (start, length, ref_doc, ref_start))):
        end = s + n - window
        if end <= last:
            continue
        if out and s <= last + 1 and d == out[-1][2] and r - s == out[-1][3] - out[-1][0]:
            out[-1][1] = end + window - out[-1][0]
        else:
            skip = max(0, last + 1 - s)
            out.append([s + skip, n - skip, d, r + skip])
        last = end
    return np.array(out, dtype=np.int64).reshape(-1, 4)


def _apply(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("n_words", "n_removed", "kept_sha256", "text")}
            for at, to, buf, offsets in text_slices(b.column(1)):
                w = Words(buf, offsets)
                gone = np.zeros(len(w.code) + 1, dtype=np.int32)
                for i in range(at, to):
                    if b.column(2)[i].is_valid:
                        factors = parse(*(b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (2, 3, 4, 5)), window)
                        begin = factors[:, 0] + w.first[i - at]
                        np.add.at(gone, begin, 1)
                        np.add.at(gone, begin + factors[:, 1], -1)
                keep = np.cumsum(gone[:-1]) == 0
                raw = buf.tobytes()
                for i in range(to - at):
                    lo, hi = w.first[i], w.first[i + 1]
                    mask = keep[lo:hi]
                    left = b" ".join([raw[x:y] for x, y in zip(w.begin[lo:hi][mask].tolist(), w.end[lo:hi][mask].tolist())])
                    out["n_words"].append(int(hi - lo))
                    out["n_removed"].append(int(hi - lo - mask.sum()))
                    out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                    if with_text:
                        out["text"].append(left.decode("utf-8"))
            names = ["n_words", "n_removed", "kept_sha256"] + ["text"] * with_text
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(out[n], type={"n_words": pa.int64(), "n_removed": pa.int64()}.get(n, pa.string())) for n in names)], names=["doc_id", *names])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    """The rows that take part, planned alike wherever they are needed, so that they are dealt
    out by document once."""
    return docs.select("doc_id", "text", F.hash("text").alias("t")).filter("doc_id is not null and text is not null")


def matches(docs: DataFrame, window: int = 50, gram: int = 16) -> DataFrame:
    """(doc_id, t, start, length, ref_doc, ref_start): word ranges that an earlier document has too, and
    where; t is hash(text), which tells rows apart that share an id."""
    if not 1 <= gram < window:
        raise ValueError("gram must lie between 1 and window - 1")
    texts = _texts(docs)
    blocks = texts.mapInArrow(_blocks(window, gram), _RUNS).filter("content is not null")  # said once, so that one shuffle serves all
    index = blocks.groupBy("content").agg(F.min(F.struct("doc_id", "t", "start", "n", "leader")).alias("o")).select("content", "o.*")
    shared = index.groupBy("leader").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1").select("leader")
    # at the boundaries of whole blocks that match: leaders with several contents
    edge = index.join(shared, "leader", "left_semi").groupBy("doc_id", "t").agg(F.collect_list(F.struct("start", "n", "content")).alias("b"))
    edge = edge.select("doc_id", "t", F.col("b.start").alias("start"), F.col("b.n").alias("n"), F.col("b.content").alias("content"))
    windows = texts.join(edge, ["doc_id", "t"]).select("doc_id", "text", "start", "n", "content").mapInArrow(_windows(window), "window long, doc_id long, pos int, content long, k int")
    earliest = windows.groupBy("window").agg(F.min(F.struct("doc_id", "pos")).alias("f"), F.max("doc_id").alias("last")).filter("f.doc_id < last")
    earliest = earliest.select("window", F.col("f.doc_id").alias("ref_doc"), F.col("f.pos").alias("ref_start"))
    late = windows.select("window", "doc_id", "content", "k").join(earliest, "window").filter("ref_doc < doc_id").groupBy("content").agg(F.collect_set(F.struct("k", "ref_doc", "ref_start")).alias("late"))
    indexed = index.select("content", F.col("doc_id").alias("first_doc"), F.col("start").alias("first_start")).join(late, "content", "left")
    found = blocks.select("doc_id", "t", "start", "n", "content").join(indexed, "content").filter("doc_id > first_doc or late is not null")
    whole = F.array(F.struct(F.col("start").alias("start"), (F.col("n") + window - 1).alias("length"), F.col("first_doc").alias("ref_doc"), F.col("first_start").alias("ref_start")))
    single = F.transform("late", lambda x: F.struct((F.col("start") + x["k"]).alias("start"), F.lit(window).alias("length"), x["ref_doc"].alias("ref_doc"), x["ref_start"].alias("ref_start")))
    return found.select("doc_id", "t", F.explode(F.when(F.expr("doc_id > first_doc"), whole).otherwise(single)).alias("s")).select("doc_id", "t", "s.*")


_MATCH = ("start", "length", "ref_doc", "ref_start")


def _of_document(found: DataFrame) -> DataFrame:
    """A document's matches as arrays in one row."""
    return found.groupBy("doc_id", "t").agg(F.collect_set(F.struct(*_MATCH)).alias("s")).select("doc_id", "t", *[F.col("s")[c].alias(c) for c in _MATCH])


def factors(docs: DataFrame, window: int = 50, gram: int = 16) -> DataFrame:
    """(doc_id, t, start, length, ref_doc, ref_start): the factors of each document against the earlier ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                found = parse(*(b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (2, 3, 4, 5)), window)
                own = [pa.array([b.column(k)[i].as_py()] * len(found), t) for k, t in ((0, pa.int64()), (1, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(found[:, k]) for k in range(4))], names=["doc_id", "t", *_MATCH])

    return _of_document(matches(docs, window, gram)).mapInArrow(run, "doc_id long, t int, start long, length long, ref_doc long, ref_start long")


def remove_repeats(docs: DataFrame, window: int = 50, gram: int = 16, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, if asked, the kept text."""
    rows = _texts(docs).join(_of_document(matches(docs, window, gram)), ["doc_id", "t"], "left").select("doc_id", "text", *_MATCH)
    none = {"start": "int", "length": "int", "ref_doc": "bigint", "ref_start": "int"}
    whole = docs.filter("doc_id is null or text is null").select("doc_id", "text", *[F.lit(None).cast(f"array<{k}>").alias(c) for c, k in none.items()])
    rows = rows.unionByName(whole).withColumn("text", F.coalesce("text", F.lit("")))
    kind = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text
    return rows.mapInArrow(_apply(window, with_text), kind)
