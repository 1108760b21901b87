"""Benchmark decontamination by spaced-seed hashing.

A token is a run of letters, digits and non-ASCII characters, ASCII letters lower-cased. A
document holds an item of the benchmark if, laid side by side at some shift, `window` successive
tokens of the item agree with the document's in at least `agree` places; an item shorter than
that must agree in the same share of all its tokens: for 10 in 12, items of up to five tokens
match only as a whole, those of six to eleven with one token replaced or beyond the document's ends.

Seeds find the shifts. A mask looks at six of eight to ten successive tokens and ignores the
rest, so a replaced token under a gap does not hide the passage. Together the masks are complete
for the default of 10 in 12: whatever two places differ, one mask fits between them. That needs
ten tokens; an item of fewer has a mask of its own for each set of places that may differ. Every seed
of a document that the index of the benchmark also has is verified around the hit, token by
token, over the whole item.

The benchmark is dealt in blocks of at most `block_bytes` of text, its size being checked first;
each block's index goes to the executors, which hold one block at a time. A larger benchmark
takes more passes over the documents, not more memory.

Defined results: null and empty texts hold nothing, null or empty items are held by nothing;
a document is reported once for each item, at its first best place; repeated rows give
repeated reports; rows with null ids are treated like others; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PUNCTUATED, U64, Words, mixed, signed, text_slices

#: Fixed masks: any two differing tokens among twelve leave one of these a place to match.
MASKS = ("11101011", "1101000111", "1110011001")
MASK_WEIGHT = 6
#: Items of fewer tokens than the longest mask get masks of their own length.
SHORT = max(map(len, MASKS))
_SALT = mixed(np.arange(1, 33, dtype=U64))
_FILTER_BITS = 22


def _seeds(code: np.ndarray, mask: str) -> np.ndarray:
    n = len(code) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    total = np.full(n, len(mask), dtype=U64)
    for k, use in enumerate(mask):
        if use == "1":
            total = total * U64(0x100000001B3) + (code[k : k + n] ^ _SALT[k])
    return mixed(total)


def _fits(same: np.ndarray, window: int, agree: int) -> int:
    """The most agreeing tokens in a window, or 0 if too few agree in each."""
    n = len(same)
    if n < window:
        hits = int(same.sum())
        return hits if hits * window >= agree * n else 0
    runs = np.concatenate([[0], np.cumsum(same)])
    best = int((runs[window:] - runs[:-window]).max())
    return best if best >= agree else 0


def _short_masks(n: int, window: int, agree: int) -> Iterator[tuple[int, str]]:
    """(first place looked at, mask) for each set of places in which an item of n tokens may differ."""
    least = max(1, -(-agree * n // window))
    for places in combinations(range(n), least):
        yield places[0], "".join("1" if k in places else "0" for k in range(places[0], places[-1] + 1))


class _Index:
    """The seeds of one block of the benchmark."""

    def __init__(self, items: list[tuple[int, str]], window: int, agree: int):
        raw = [(text or "").encode() for _, text in items]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        w = Words(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets, lower=True, blanks=PUNCTUATED)
        self.ids, self.code, self.first, self.window, self.agree = [i for i, _ in items], w.code, w.first, window, agree
        item_of = np.repeat(np.arange(len(items)), np.diff(w.first))
        self.masks = []
        for mask in MASKS:
            n = len(w.code) - len(mask) + 1
            self._add(mask, np.flatnonzero(item_of[:n] == item_of[len(mask) - 1 :]) if n > 0 else np.zeros(0, dtype=np.int64), _FILTER_BITS)
        own: dict[str, list[np.ndarray]] = {}
        size = np.diff(w.first)
        for n in range(1, SHORT):
            first = w.first[:-1][size == n]
            for k, mask in _short_masks(n, window, agree) if len(first) else ():
                own.setdefault(mask, []).append(first + k)
        for mask, places in own.items():
            at = np.concatenate(places)
            self._add(mask, at, min(_FILTER_BITS, len(at).bit_length() + 6))
        self.item_of = item_of

    def _add(self, mask: str, at: np.ndarray, bits: int) -> None:
        """Index the seeds of a mask at these tokens."""
        seed = _seeds(self.code, mask)
        order = at[np.argsort(seed[at], kind="stable")]
        maybe = np.zeros(1 << bits, dtype=bool)
        maybe[(seed[order] >> U64(64 - bits)).astype(np.int64)] = True
        self.masks.append((mask, seed[order], order, maybe, bits))

    def hits(self, w: Words) -> np.ndarray:
        """Distinct (document, item, first token of the item's place in w.code)."""
        doc_of = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
        out = []
        for mask, seeds, where, maybe, bits in self.masks:
            seed = _seeds(w.code, mask)
            at = np.flatnonzero(maybe[(seed >> U64(64 - bits)).astype(np.int64)])
            at = at[doc_of[at] == doc_of[at + len(mask) - 1]]
            lo, hi = (np.searchsorted(seeds, seed[at], side=side) for side in ("left", "right"))
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            for k in range(int(n.max()) if len(n) else 0):  # the k-th item with this seed
                more = n > k
                token = where[lo[more] + k]
                item = self.item_of[token]
                out.append(np.stack([doc_of[at[more]], item, at[more] - (token - self.first[item])], axis=1))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), dtype=np.int64)

    def found(self, w: Words) -> dict[tuple[int, int], tuple[int, int]]:
        """(document, item) -> (agreeing tokens, first token) of the verified overlaps."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for doc, item, start in self.hits(w).tolist():
            size = self.first[item + 1] - self.first[item]
            lo, hi = max(start, w.first[doc]), min(start + size, w.first[doc + 1])
            same = np.zeros(size, dtype=bool)
            same[lo - start : hi - start] = w.code[lo:hi] == self.code[self.first[item] + lo - start : self.first[item] + hi - start]
            fit = _fits(same, self.window, self.agree)
            if fit and (-fit, lo) < (lambda x: (-x[0], x[1]))(best.get((doc, item), (0, 0))):
                best[doc, item] = (fit, lo)
        return {k: (fit, lo - int(w.first[k[0]])) for k, (fit, lo) in best.items()}


_built: dict[tuple, _Index] = {}


def _index(items: list[tuple[int, str]], window: int, agree: int) -> _Index:
    """The index of a block, kept while a worker's tasks ask for the same one."""
    key = (hash(tuple(items)), len(items), window, agree)
    if key not in _built:
        _built.clear()
        _built[key] = _Index(items, window, agree)
    return _built[key]


def _search(items: list[tuple[int, str]], window: int, agree: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(items, window, agree)
        for b in batches:
            for at, to, buf, offsets in text_slices(b.column(1)):
                found = index.found(Words(buf, offsets, lower=True, blanks=PUNCTUATED))
                if found:
                    docs = b.column(0)[at:to].take(pa.array([d for d, _ in found]))
                    yield pa.RecordBatch.from_arrays(
                        [docs, pa.array([index.ids[i] for _, i in found], pa.int64()), pa.array([n for n, _ in found.values()], pa.int64()), pa.array([s for _, s in found.values()], pa.int64())],
                        names=["doc_id", "item_id", "agreeing", "start"],
                    )

    return run


def _free(items: list[tuple[int, str]], window: int, agree: int, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(items, window, agree)
        for b in batches:
            for at, to, buf, offsets in text_slices(b.column(text).fill_null("")):
                found = index.found(Words(buf, offsets, lower=True, blanks=PUNCTUATED))
                keep = np.ones(to - at, dtype=bool)
                keep[[d for d, _ in found]] = False
                yield b.slice(at, to - at).filter(pa.array(keep))

    return run


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about half of `block_bytes` of text; the size is checked first."""
    items = benchmark.select("item_id", "text").filter("text is not null and text <> ''")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-2 * size // block_bytes) if size > block_bytes else 1
    for k in range(blocks):
        block = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield [(r[0], r[1]) for r in block.collect()]  # at most a block


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 12, agree: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, item_id, agreeing, start): each item that a document holds.

    agreeing counts the equal tokens of the best window, start is the token of the document
    where the item begins."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = None
    for rows in _blocks(benchmark, block_bytes):
        part = texts.mapInArrow(_search(rows, window, agree), "doc_id long, item_id long, agreeing long, start long")
        out = part if out is None else out.union(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 12, agree: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows whose own text holds no item of the benchmark, with all their columns.

    Each row is judged by its text, whatever its id: rows with a null id are judged too, and a
    row that shares its id with a contaminated one stays if its own text is free."""
    for rows in _blocks(benchmark, block_bytes):
        docs = docs.mapInArrow(_free(rows, window, agree, docs.columns.index("text")), docs.schema)
    return docs
