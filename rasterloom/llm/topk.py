"""Exact top-k search: BM25 over a sharded inverted index with block-max WAND pruning.

Documents are dealt in shards of about `shard_bytes` of text by hash, so a shard's index fits a
task at any size of the corpus. A shard's posting lists are cut in blocks by ranges of RANGE
documents, and each list and each block keeps its largest impact. A query walks its lists from
the largest upper bound down. The pivot is the first list from which on the bounds that are left
sum to less than the k-th score so far: from there on no document that was not met before can
still enter, and of what follows only those blocks are opened whose range has a document that the
blocks' maxima can lift over that score. Everything else is skipped, within lists too. Only
bounds under the k-th score are ever skipped, so the shard's top k is exact. Lists of very common words
are kept as rows over all documents; a pack of queries is multiplied with them first, in one product.

Scores use statistics of the whole corpus - number of documents, mean length and document
frequencies, all of one distributed pass - so the shards' scores can be merged: the top k of all
shards' top k are the top k. Ties go to the smaller id.

A shard is a partition: its documents come first and are indexed as they come, then the queries
stream past that index, so a task holds one shard and one batch of queries however many there are.
The queries lie once, in packs, in the folder that the cluster shares, and every shard's task reads
them there; only documents are shuffled, so disk grows with the input and not with queries x shards.

BM25 with k1 = 1.2 and b = 0.75, idf = ln(1 + (N - df + 0.5) / (df + 0.5)), summed over the
distinct words of the query. Words are runs without blanks, ASCII letters lower-cased.

Defined results: a query without words finds nothing; rows that share a query id are one query
of all their words; null and empty documents count as documents of length 0 and are never found;
rows with a null id are left out; repeated documents count as often as they stand there, and are
found as often; without documents or queries there are no rows; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, signed, spans, stored, text_slices

K1, B = 1.2, 0.75
#: Documents of one block's range.
RANGE = 16
#: Lists that hold one document in so many are kept as a row over all documents as well, the longest
#: first and as many as make up _ROWS numbers.
_OFTEN, _ROWS = 16, 1 << 22
#: Scores held at once of queries that are multiplied with those rows together, the fewest such queries, and
#: of how many rows a query must have one on average.
_SCORES, _TOGETHER, _USED = 1 << 20, 4, 16
_BITS = 1 << 23
#: Words of the queries in one pack; a query is never cut.
_PACK = 1 << 14
#: Scores are compared after rounding; what is less than this under a score may equal it.
_NEAR = 1e-7


def _terms(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, frequency) of every distinct word of every document, by document."""
    doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    term = signed(w.code)
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
    at = np.flatnonzero(new)
    return doc[at], term[at], np.diff(np.append(at, len(doc)))


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at, to, buf, offsets in text_slices(b.column(1)):
            doc, term, _ = _terms(Words(buf, offsets, lower=True))
            yield pa.RecordBatch.from_arrays([b.column(0)[at:to].take(pa.array(doc)), pa.array(term)], names=["query_id", "term"])


def _counts(wanted: np.ndarray):
    """Document frequencies of wanted terms, and documents, words and bytes as term null, for each slice of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, buf, offsets in text_slices(b.column(0), 2 << 20):
                w = Words(buf, offsets, lower=True)
                _, term, _ = _terms(w)
                bit = term & (_BITS - 1)
                term, df = np.unique(term[(wanted[bit >> 6] >> (bit & 63)) & 1 == 1], return_counts=True)
                none = np.zeros(len(df), dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(term, 0), mask=np.append(none, 1) == 1), pa.array(np.append(df, len(offsets) - 1)), pa.array(np.append(none, len(w.code))), pa.array(np.append(none, len(buf)))],
                    names=["term", "df", "words", "bytes"],
                )

    return run


class Shard:
    """The inverted index of some documents, added in parts; N documents in all corpora."""

    def __init__(self, total: int, mean: float):
        self.total, self.mean = total, mean
        self.parts: tuple[list[np.ndarray], ...] = ([], [], [], [])
        self.size = 0
        self.ready = False

    def add(self, ids: np.ndarray, text: pa.Array) -> None:
        for at, to, buf, offsets in text_slices(text):
            w = Words(buf, offsets, lower=True)
            doc, term, freq = _terms(w)
            size = np.diff(w.first)
            norm = K1 * (1 - B + B * size / self.mean)
            for part, column in zip(self.parts, (ids[at:to], (doc + self.size).astype(np.int32), term, freq * (K1 + 1) / (freq + norm[doc]))):
                part.append(column)
            self.size += to - at

    def finish(self) -> None:
        def joined(k: int, kind) -> np.ndarray:
            out = np.concatenate(self.parts[k]) if self.parts[k] else np.zeros(0, dtype=kind)
            self.parts[k].clear()
            return out

        self.ready = True
        self.ids = joined(0, np.int64)
        term = joined(2, np.int64)
        order = np.argsort(term, kind="stable").astype(np.int32)  # documents stay in order within a term
        term = term[order]
        self.doc = joined(1, np.int32)[order]
        self.impact = joined(3, np.float64)[order]
        del order
        part = self.doc // RANGE
        head = np.ones(len(term), dtype=bool)
        head[1:] = term[1:] != term[:-1]
        self.begin = np.flatnonzero(head)  # lists
        self.term = term[self.begin]
        self.length = np.diff(np.append(self.begin, len(term)))
        del term
        head[1:] |= part[1:] != part[:-1]
        self.block = np.flatnonzero(head)  # blocks
        self.block_length = np.diff(np.append(self.block, len(head)))
        self.range = part[self.block]
        self.block_most = np.maximum.reduceat(self.impact, self.block) if len(part) else np.zeros(0)
        self.first_block = np.searchsorted(self.block, self.begin)
        self.blocks = np.diff(np.append(self.first_block, len(self.block)))
        self.most = np.maximum.reduceat(self.impact, self.begin) if len(part) else np.zeros(0)
        self.ranges = -(-max(1, self.size) // RANGE)
        #: Long lists as rows over all documents, which add up without looking documents up.
        often = np.flatnonzero(self.length * _OFTEN >= max(1024, self.size))
        often = often[np.argsort(-self.length[often], kind="stable")][: _ROWS // max(1, self.size)]
        self.row = np.full(len(self.term), -1)
        self.row[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), self.size))
        for row, k in zip(self.rows, often.tolist()):
            at = slice(self.begin[k], self.begin[k] + self.length[k])
            row[self.doc[at]] = self.impact[at]

    def _add_lists(self, score: np.ndarray, lists: np.ndarray, idf: np.ndarray) -> None:
        short = self.length[lists] < 256
        some, weight = lists[short], idf[short]
        n = self.length[some]
        posting = spans(self.begin[some], n)
        if len(posting):
            score += np.bincount(self.doc[posting], weights=self.impact[posting] * np.repeat(weight, n), minlength=self.size)
        some, weight = lists[~short], idf[~short]
        row = self.row[some]
        for k, w in zip(row[row >= 0].tolist(), weight[row >= 0].tolist()):
            score += self.rows[k] * w
        some, weight = some[row < 0], weight[row < 0]
        if len(some):
            at = [slice(i, i + n) for i, n in zip(self.begin[some].tolist(), self.length[some].tolist())]
            impact = np.concatenate([self.impact[i] for i in at]) * np.repeat(weight, self.length[some])
            score += np.bincount(np.concatenate([self.doc[i] for i in at]), weights=impact, minlength=self.size)

    def _add_open_blocks(self, score: np.ndarray, live: np.ndarray, lists: np.ndarray, idf: np.ndarray, least: float) -> np.ndarray:
        """Add the lists' blocks of ranges where a live document can reach `least`; the live ones left."""
        n = self.blocks[lists]
        block = spans(self.first_block[lists], n)
        weight = np.repeat(idf, n)
        best = np.zeros(self.ranges)
        np.maximum.at(best, live // RANGE, score[live])
        bound = np.bincount(self.range[block], weights=weight * self.block_most[block], minlength=self.ranges)
        open_ = (best > 0) & (best + bound >= least)
        mine = open_[self.range[block]]
        block, weight = block[mine], weight[mine]
        n = self.block_length[block]
        posting = spans(self.block[block], n)
        if len(posting):
            score += np.bincount(self.doc[posting], weights=self.impact[posting] * np.repeat(weight, n), minlength=self.size)
        return live[open_[live // RANGE]]

    def search(self, terms: np.ndarray, df: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best, ties to the smaller id."""
        return next(self.search_all(terms, df, np.array([0, len(terms)]), k))

    def search_all(self, terms: np.ndarray, df: np.ndarray, first: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same for many queries; first: where each one's terms begin, with the total appended.

        Their lists that are rows are summed in one matrix product for many queries; what is left is walked."""
        n = len(first) - 1
        if not len(self.term):
            yield from [(np.zeros(0, dtype=np.int64), np.zeros(0))] * n
            return
        at = np.minimum(np.searchsorted(self.term, terms), len(self.term) - 1)
        here = np.flatnonzero(self.term[at] == terms)
        at, df, first = at[here], df[here], np.searchsorted(here, first)
        idf = np.log1p((self.total - df + 0.5) / (df + 0.5))
        step = max(1, _SCORES // max(self.size, len(self.rows)))
        for q in range(0, n, step):
            most = min(n, q + step)
            own = slice(first[q], first[most])
            row = self.row[at[own]]
            often = row >= 0
            if most - q >= _TOGETHER and 0 < (most - q) * len(self.rows) <= _USED * often.sum():
                weight = np.zeros((most - q, len(self.rows)))
                query = np.repeat(np.arange(most - q), np.diff(first[q : most + 1]))
                weight[query[often], row[often]] = idf[own][often]
                scores = weight @ self.rows
            else:
                scores, often = np.zeros((most - q, self.size)), np.zeros(len(row), dtype=bool)
            for i in range(q, most):
                mine = slice(first[i], first[i + 1])
                walked = ~often[first[i] - first[q] : first[i + 1] - first[q]]
                yield self._walk(scores[i - q], at[mine][walked], idf[mine][walked], k)

    def _walk(self, score: np.ndarray, at: np.ndarray, idf: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best once these lists are added to the scores so far."""
        bound = idf * self.most[at]
        order = np.argsort(-bound, kind="stable")
        at, idf, bound = at[order], idf[order], bound[order]
        left = np.append(np.cumsum(bound[::-1])[::-1], 0.0)  # of the lists from here on
        work = np.cumsum(self.length[at])
        done, step, least = 0, 4096, 0.0
        while done < len(at):
            if left[done] < least:  # the pivot: no new document can enter
                live = np.flatnonzero(score + left[done] >= least)
                if len(live) * RANGE <= self.size:
                    live = self._add_open_blocks(score, live, at[done:], idf[done:], least)
                    return self._best(score, live, k)
            to = max(done + 1, int(np.searchsorted(work, (work[done - 1] if done else 0) + step, side="right")))
            if left[done] >= least:  # stop at the pivot
                to = min(to, max(done + 1, int(np.searchsorted(-left, -least, side="right"))))
            self._add_lists(score, at[done:to], idf[done:to])
            done, step = to, step * 4
            if self.size > k:
                least = max(least, float(np.partition(score, self.size - k)[self.size - k]) - _NEAR)
        return self._best(score, np.flatnonzero((score > 0) & (score >= least)), k)

    def _best(self, score: np.ndarray, live: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(live) > 4 * k:
            live = live[score[live] >= np.partition(score[live], len(live) - k)[len(live) - k] - _NEAR]
        ids, value = self.ids[live], np.round(score[live], 9)
        keep = np.lexsort((ids, -value))[:k]
        return ids[keep], value[keep]


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries (id, terms, df) in packs: their ids, how many terms each has, all terms, all df."""
    for b in batches:
        first = np.append(0, np.cumsum(b.column(1).value_lengths().to_numpy()))
        cut = [0]
        while cut[-1] < b.num_rows:
            cut.append(max(cut[-1] + 1, int(np.searchsorted(first, first[cut[-1]] + _PACK, side="right")) - 1))
        columns = (cut, b.column(0)), (cut, np.diff(first)), (first[cut], b.column(1).flatten()), (first[cut], b.column(2).flatten())
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v)) for at, v in columns], names=["ids", "sizes", "terms", "df"])


def _search(k: int, total: int, mean: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(total, mean)
        for b in batches:  # a partition is a shard: kind 0 its documents, then kind 1 the packs of queries
            kind = b.column(0).to_numpy()
            split = int(np.searchsorted(kind, 1))
            if split:
                if shard.ready:
                    raise RuntimeError("documents of a shard came after its queries")
                shard.add(b.column(5)[:split].to_numpy(), b.column(6)[:split])
            if split == len(kind):
                continue
            if not shard.ready:
                shard.finish()
            for i in range(split, len(kind)):
                asked, sizes, terms, df = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (1, 2, 3, 4))
                first = np.append(0, np.cumsum(sizes))
                out: list[list[np.ndarray]] = [[], [], []]
                for query, (ids, scores) in zip(asked, shard.search_all(terms, df, first, k)):
                    for column, value in zip(out, (np.full(len(ids), query), ids, scores)):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["query_id", "doc_id", "score"])

    return run


def search(docs: DataFrame, queries: DataFrame, k: int = 10, shard_bytes: int = 32 << 20) -> DataFrame:
    """(query_id, doc_id, rank, score): the k best documents for each query (query_id, text)."""
    texts = docs.filter("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    asked = queries.filter("query_id is not null and text is not null").select("query_id", "text")
    terms = asked.mapInArrow(_query_terms, "query_id long, term long").distinct()
    bits = terms.select((F.col("term").bitwiseAND(_BITS - 1)).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("bits"))
    wanted = np.zeros(_BITS // 64, dtype=np.int64)
    for word, value in bits.collect():  # at most _BITS / 64 rows, whatever the queries
        wanted[word] = value
    counts = texts.select("text").mapInArrow(_counts(wanted), "term long, df long, words long, bytes long")
    counts = stored(counts.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("df", "words", "bytes")]))
    totals = counts.filter("term is null").first()
    total, words, size = (totals.df, totals.words, totals.bytes) if totals else (0, 0, 0)
    shards = max(1, -(-size // shard_bytes))
    weighted = terms.join(counts.filter("term is not null").select("term", "df"), "term").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "df"))).alias("t"))
    parts = ["ids", "sizes", "terms", "df"]
    packs = stored(weighted.select("query_id", "t.term", "t.df").mapInArrow(_packs, ", ".join(f"{c} array<long>" for c in parts)))
    # One stream of packs with a row of kind 0 before them, which meets the documents; the packs meet the row that ends the shard.
    opened = packs.coalesce(1).withColumn("at", F.monotonically_increasing_id())
    opened = opened.withColumn("kind", F.explode(F.when(F.col("at") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    opened = opened.select("kind", *[F.when(F.col("kind") == 1, F.col(c)).alias(c) for c in parts])
    dealt = texts.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int").alias("shard"), F.lit(1).alias("unlike"), "doc_id", "text")
    ends = docs.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit(0).alias("unlike"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    dealt = dealt.unionByName(ends).repartitionById(shards, F.col("shard")).drop("shard")
    # A cartesian product of one partition with each shard's: it holds the shard and streams the packs from where they lie.
    streams = opened.join(dealt.hint("shuffle_replicate_nl"), F.col("kind") != F.col("unlike")).select("kind", *parts, "doc_id", "text")
    found = streams.mapInArrow(_search(k, total, max(1e-9, words / max(1, total))), "query_id long, doc_id long, score double")
    rank = F.expr("row_number() over (partition by query_id order by score desc, doc_id)")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "doc_id", F.col("rank").cast("int").alias("rank"), "score")
