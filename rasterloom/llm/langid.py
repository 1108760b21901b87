"""Language identification by cross-parsing entropy over suffix automata.

For every language one suffix automaton holds a sample of labelled text. A text is parsed with
it greedily: each phrase is the longest match with any substring of the sample, and where a match
ends the next phrase begins. Fewer phrases mean that the text is more like the sample; times the
logarithm of the sample's length, per letter, that is the cross entropy, and the language with
the least wins (ties: the smaller name).

Every letter of a sample, in whatever script, is a class of its own. Automata are tables that
many pieces of text walk in step, one array operation for all: dense ones while all languages'
together hold at most `dense` entries, hashed ones for the languages beyond; both say the same.
Pieces are SEGMENT letters of one document; a document's phrases are summed over its pieces, so
the whole text counts, however long.

The sample is bounded: per language the whole texts of at most `rows` labelled documents, one
for each share of the hash values, the one of smallest xxhash64(doc_id) among those of at most
`longest` characters. Only a share without any takes a longer one, and of that its middle.

Defined results: null text and texts without a letter are `und` with score 0, and so is every
text if nothing is labelled; repeated rows repeat their result; rows with a null id are predicted
but never learned from; other columns are ignored. The score is the share by which the second
best language needs more phrases than the best, from 0 to 1."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, held_out, spans

SEGMENT = 512
_CODES = 0x110000
_MISS = 1 << 30
_DENSE = 1 << 25


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(_CODES)])


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """All substrings of one text over small integers: per state, letter -> state."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return go


class Walk:
    """An automaton as (state, letter) -> state, with _MISS added where a new phrase begins.

    The last letter is padding and moves nothing."""

    def __init__(self, go: list[dict[int, int]], width: int, dense: bool):
        self.width, self.pad, self.states = width, width - 1, len(go)
        begin = np.zeros(width, dtype=np.int32)
        for c, to in go[0].items():
            begin[c] = to
        self.begin = begin | _MISS
        sizes = [len(moves) for moves in go]
        key = np.repeat(np.arange(len(go), dtype=np.int64) * width, sizes) + np.fromiter((c for moves in go for c in moves), np.int64, sum(sizes))
        to = np.fromiter((t for moves in go for t in moves.values()), np.int32, sum(sizes))
        self.table = None
        if dense:
            table = np.tile(self.begin, len(go))
            table[key] = to
            table[self.pad :: width] = np.arange(len(go))
            self.table = table
        else:
            bits = max(4, (2 * len(key)).bit_length())
            self.shift, self.last = U64(64 - bits), (1 << bits) - 1
            self.keys, self.to = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int32)
            slot = self._slot(key)
            while len(key):  # those that find their slot empty take it, one for each slot
                free = np.flatnonzero(self.keys[slot] < 0)
                _, one = np.unique(slot[free], return_index=True)
                one = free[one]
                self.keys[slot[one]], self.to[slot[one]] = key[one], to[one]
                rest = np.ones(len(key), dtype=bool)
                rest[one] = False
                key, to, slot = key[rest], to[rest], (slot[rest] + 1) & self.last

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(U64) * U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table.take(state * self.width + letter)
        out = np.where(letter == self.pad, state, self.begin[letter])
        key = state * np.int64(self.width) + letter
        slot, who = self._slot(key), np.arange(len(key))
        while len(who):
            held = self.keys[slot]
            hit = held == key
            out[who[hit]] = self.to[slot[hit]]
            go_on = ~hit & (held >= 0)
            who, key, slot = who[go_on], key[go_on], (slot[go_on] + 1) & self.last
        return out


class LanguageModel:
    """The automata of all languages.

    Letter classes of all samples together: 0 is whatever is not a letter, 1 a letter that is in
    no sample. Each automaton has classes of its own, 1 for letters that its sample has not."""

    def __init__(self, samples: dict[str, str], dense: int = _DENSE):
        self.languages = sorted(samples)
        known = sorted({c for text in samples.values() for c in text.lower() if c.isalpha()})
        self.classes = _is_letter().astype(np.int32)
        self.classes[[ord(c) for c in known]] = np.arange(2, len(known) + 2)
        self.pad = len(known) + 2
        self.walks: list[Walk] = []
        self.local: list[np.ndarray] = []
        self.scale: list[float] = []
        for name in self.languages:
            text = self.letters(samples[name])
            own = np.unique(text[text > 1])
            local = np.minimum(np.arange(self.pad + 1), 1).astype(np.int32)
            local[own] = np.arange(2, len(own) + 2)
            local[self.pad] = len(own) + 2
            go = suffix_automaton(local[text].tolist())
            entries = len(go) * (len(own) + 3)
            self.walks.append(Walk(go, len(own) + 3, entries <= dense))
            dense -= entries if entries <= dense else 0
            self.local.append(local)
            self.scale.append(math.log2(max(2, len(text))))

    def letters(self, text: str) -> np.ndarray:
        """Letter classes of a text; a run of other characters is one."""
        out = self.classes[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        keep = out != 0
        keep[1:] |= out[:-1] != 0
        return out[keep]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """(texts, languages): the number of phrases of each parse."""
        size = np.array([len(t) for t in texts])
        pieces = np.maximum(1, -(-size // SEGMENT))
        first = np.cumsum(pieces) - pieces
        grid = np.full((int(pieces.sum()), SEGMENT), self.pad, dtype=np.int32)
        grid.reshape(-1)[spans(first * SEGMENT, size)] = np.concatenate(texts)
        used = int(np.minimum(size.max(), SEGMENT))
        steps = np.ascontiguousarray(grid.T[:used])
        counts = np.empty((len(grid), len(self.walks)), dtype=np.int32)
        for k, (walk, local) in enumerate(zip(self.walks, self.local)):
            state = np.zeros(len(grid), dtype=np.int32)
            misses = np.zeros(len(grid), dtype=np.int32)
            for letter in steps:
                state = walk.step(state, local.take(letter))
                misses += state >> 30
                state &= _MISS - 1
            counts[:, k] = misses + 1
        return np.add.reduceat(counts, first, axis=0)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [("und", 0.0)] * len(texts)
        if not self.languages:
            return out
        some = [(i, self.letters(t)) for i, t in enumerate(texts) if t]
        some = [(i, t) for i, t in some if len(t) and t.max() > 0 and any(map(str.isalpha, texts[i]))]
        at = 0
        while at < len(some):
            to, letters = at, 0
            while to < len(some) and (letters < 1 << 21 or to == at):
                letters += len(some[to][1])
                to += 1
            cost = self.phrases([t for _, t in some[at:to]]) * np.array(self.scale)
            for (i, _), own in zip(some[at:to], cost):
                best = int(own.argmin())
                rest = np.delete(own, best)
                score = 1.0 if not len(rest) else float(min(1.0, max(0.0, 1 - own[best] / rest.min())))
                out[i] = (self.languages[best], score)
            at = to
        return out


_built: dict[int, LanguageModel] = {}


def _predict(samples: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(tuple(sorted(samples.items())))
        if key not in _built:  # a worker serves many tasks
            _built.clear()
            _built[key] = LanguageModel(samples)
        for b in batches:
            for at in range(0, len(b), 1024):
                part = b.slice(at, 1024)
                found = _built[key].predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def language_samples(docs: DataFrame, modulus: int = 3, remainder: int = 1, rows: int = 32, longest: int = 2000) -> dict[str, str]:
    """Per language of the documents that may be learned from, the text of its automaton."""
    known = docs.select("doc_id", "text", "lang").filter("doc_id is not null and lang is not null and text is not null").filter(~held_out(F.col("doc_id"), modulus, remainder))
    known = known.withColumn("h", F.struct((F.length("text") > longest).alias("long"), F.xxhash64("doc_id").alias("hash")))
    first = known.groupBy("lang", F.pmod(F.col("h")["hash"], F.lit(rows)).alias("share")).agg(F.min("h").alias("h")).select("lang", "h")
    middle = F.expr(f"if(length(text) <= {longest}, text, substring(text, (length(text) - {longest}) div 2, {longest}))")
    picked = known.join(F.broadcast(first), ["lang", "h"]).groupBy("lang", F.col("h")["hash"].alias("hash")).agg(F.min(middle).alias("text"))  # at most `rows` rows a language
    out: dict[str, list[str]] = {}
    for r in sorted(picked.collect()):
        out.setdefault(r[0], []).append(r[2])
    return {k: " ".join(v) for k, v in out.items()}


def identify_languages(docs: DataFrame, modulus: int = 3, remainder: int = 1) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    samples = language_samples(docs, modulus, remainder)
    found = docs.select("doc_id", "text").mapInArrow(_predict(samples), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "lang_pred", "score")
