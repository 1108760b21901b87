"""op9 with many shards: what is moved, and queries in packs."""

import numpy as np
import pyarrow as pa
import pytest

from rasterloom.llm import topk
from rasterloom.llm.common import Words


def _records_written(spark) -> dict[int, int]:
    """Records each stage has written to its shuffle."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    none, doubles = sc._jvm.java.util.ArrayList(), sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, doubles, none)
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_queries_are_not_shuffled_to_every_shard(spark):
    docs = spark.createDataFrame([(i, f"own{i} pair{i // 2} " * 3) for i in range(400)], "doc_id long, text string")
    asked = docs.filter("doc_id < 100").withColumnRenamed("doc_id", "query_id")
    before = _records_written(spark)
    found = topk.search(docs, asked, k=2, shard_bytes=300).collect()
    moved = {s: n for s, n in _records_written(spark).items() if s not in before}
    assert sorted((r.query_id, r.rank, r.doc_id) for r in found) == sorted((q, rank, d) for q in range(100) for rank, d in ((1, q), (2, q ^ 1)))
    assert 0 < max(moved.values()) < 1000  # a copy of the queries for each shard would be 5,700


def test_packs_hold_every_query_once(monkeypatch):
    monkeypatch.setattr(topk, "_PACK", 7)
    sizes = [3, 4, 1, 20, 2, 5, 7, 1]
    words = [list(range(100 * i, 100 * i + n)) for i, n in enumerate(sizes)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), pa.array(words), pa.array([[-w for w in x] for x in words])], names=["query_id", "term", "df"])
    packs = [row for b in topk._packs(iter([batch, batch.slice(2, 3)])) for row in b.to_pylist()]
    assert [p["ids"] for p in packs] == [[0, 1], [2], [3], [4, 5], [6], [7], [2], [3], [4]]
    for p in packs:
        assert p["sizes"] == [sizes[i] for i in p["ids"]]
        assert p["terms"] == np.concatenate([words[i] for i in p["ids"]]).tolist() and p["df"] == [-w for w in p["terms"]]


@pytest.mark.parametrize("limits", [{}, {"_ROWS": 3 * 1500}, {"_SCORES": 6 * 1500}, {"_SCORES": 1}, {"_USED": 1 << 30}, {"_USED": 0}])
def test_queries_together_find_what_each_finds(monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, rng.integers(1, 120)) if x < 5000) for _ in range(1500)]
    shard = topk.Shard(len(texts), 40.0)
    shard.add(np.arange(len(texts)), pa.array(texts))
    shard.finish()
    raws = [np.frombuffer(t.encode(), dtype=np.uint8) for t in [*texts[::40], "", "unheard of", *texts[7::90]]]
    terms = [topk._terms(Words(raw, np.array([0, len(raw)]), lower=True))[1] for raw in raws]
    df = [np.array([max(1, shard.length[shard.term == t].sum()) for t in x.tolist()], dtype=np.int64) for x in terms]
    first = np.append(0, np.cumsum([len(x) for x in terms]))
    found = list(shard.search_all(np.concatenate(terms), np.concatenate(df), first, 10))
    assert len(found) == len(terms)
    place = {t: k for k, t in enumerate(shard.term.tolist())}
    for x, n, (ids, scores) in zip(terms, df, found):
        score = np.zeros(len(texts))
        for t, d in zip(x.tolist(), n.tolist()):
            if t in place:
                at = slice(shard.begin[place[t]], shard.begin[place[t]] + shard.length[place[t]])
                score[shard.doc[at]] += shard.impact[at] * np.log1p((len(texts) - d + 0.5) / (d + 0.5))
        value = np.round(score, 9)
        want = [int(i) for i in np.lexsort((np.arange(len(texts)), -value))[:10] if score[i] > 0]
        assert ids.tolist() == want and scores.tolist() == pytest.approx(value[want].tolist(), abs=2e-9)
