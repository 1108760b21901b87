"""Each text operator against brute force, on a small fixture of awkward rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.llm import bpe, chat, decontaminate, langid, line_dedup, minhash, quality, substring_dedup, topk, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 97}x{i % 89}" for i in range(400))
LINES = "one two three four five six seven eight nine"
KIND = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("n", T.IntegerType()), ("gone", T.StringType()), ("key", T.LongType()))])


@pytest.fixture(scope="module")
def rows():
    texts = [None, "", "   ", "a", LONG, LONG, "head " + LONG, LONG.replace("w5x5", "other"), LINES, LINES.replace("five", "5"), LINES + " ten", f"\t{LINES}\r\nshort\n\nshort", "short", "é ü\nñ", LONG * 30]
    return [(i * 3, t, "en", i, "x", 7) for i, t in enumerate(texts)] + [(12, LONG, "en", 1, "x", 7), (None, "no id " + LONG, None, 1, "x", 7)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, KIND)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def test_line_dedup(docs, rows):
    first, near = {}, {}
    places = sorted({(d, k, tuple(x.split())) for d, t, *_ in rows if d is not None for k, x in enumerate((t or "").split("\n"))})
    for d, k, w in places:
        if w:
            first.setdefault(w, (d, k))

    def within_one(a, b):
        if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 8:
            return False
        p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[p + 1 :] == b[p + 1 :] or a[p + 1 :] == b[p:] or a[p:] == b[p + 1 :]

    for w, at in first.items():
        near[w] = any(other < at and within_one(w, v) for v, other in first.items())
    want = {}
    for d, t, *_ in rows:
        lines = [] if t is None else t.split("\n")
        gone = [k for k, x in enumerate(lines) if d is not None and x.split() and (near[tuple(x.split())] or first[tuple(x.split())] < (d, k))]
        kept = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        want[d, t] = (len(lines), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = Counter(tuple(r) for r in line_dedup.line_report(docs).collect())
    assert got == Counter((d, *want[d, t]) for d, t, *_ in rows)


def test_line_dedup_keeps_columns(docs, empty):
    kept = line_dedup.remove_duplicate_lines(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {0, 3, 6, 12, 24, None} <= ids and 27 not in ids and 36 not in ids
    assert line_dedup.remove_duplicate_lines(empty).count() == 0


def test_substring_dedup(docs, rows, empty):
    starts = {}
    for d, t, *_ in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - 49):
            if d is not None:
                key = tuple(w[i : i + 50])
                starts[key] = min(starts.get(key, d), d)
    want = Counter()
    for d, t, *_ in rows:
        w = WORD.findall(t or "")
        keep = [True] * len(w)
        for i in range(len(w) - 49):
            if d is not None and starts[tuple(w[i : i + 50])] < d:
                keep[i : i + 50] = [False] * 50
        left = " ".join(x for x, k in zip(w, keep) if k)
        want[d, len(w), keep.count(False), hashlib.sha256(left.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in substring_dedup.remove_repeats(docs).collect()) == want
    assert substring_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("words", [2, 5])
def test_minhash(docs, rows, empty, words):
    sets = {}
    for d, t, *_ in rows:
        w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[d, t] = frozenset(zip(*(w[i:] for i in range(words)))) if len(w) >= words else frozenset([tuple(w)] if w else [])
    label = {d: d for d, *_ in rows}
    for _ in rows:
        for (a, _x), s in sets.items():
            for (b, _y), r in sets.items():
                if s and r and a is not None and b is not None and 100 * len(s & r) >= 80 * len(s | r):
                    label[a] = label[b] = min(label[a], label[b])
    want = Counter((d, len(sets[d, t]), label[d], d == label[d]) for d, t, *_ in rows)
    assert Counter(tuple(r) for r in minhash.near_duplicates(docs, words).collect()) == want
    assert minhash.near_duplicates(empty, words).count() == 0
    assert minhash.keep_one_each(docs).columns == docs.columns


def test_decontaminate(spark, docs, empty):
    passage = [f"q{i}" for i in range(20)]
    swapped = [*passage[:7], "zz", *passage[8:13], "yy", *passage[14:]]
    broken = [x if i % 4 else "no" for i, x in enumerate(passage)]
    more = spark.createDataFrame([Row(doc_id=k, text=t) for k, t in ((500, "a b " + " ".join(swapped) + " c"), (501, " ".join(broken)), (502, " ".join(passage[:13]).upper() + "!"))])
    bench = spark.createDataFrame([(1, " ".join(passage)), (2, None), (3, ""), (4, "w1x1 nothing")], "item_id long, text string")
    every = docs.select("doc_id", "text").unionByName(more)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(every, bench).collect()} == {(500, 1), (502, 1)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(every, bench, block_bytes=16).collect()} == {(500, 1), (502, 1)}
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_masks_are_complete():
    for a in range(12):
        for b in range(a):
            assert any(all(m[k - o] == "0" for k in (a, b) if 0 <= k - o < len(m)) for m in decontaminate.MASKS for o in range(13 - len(m)))


def test_bpe_equals_the_library(docs, rows):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    theirs, ours = Tokenizer.from_file(path), bpe.ForcedBoundaryBpe(path)
    for text in ["", "I'LL don't <|endoftext|>x", "naïve ΣΑΣ İ 12345   ¡ño!", "日本語 text😀", LONG]:
        assert ours.encode(text) == theirs.encode(text, add_special_tokens=False).ids
    want = Counter()
    for d, t, *_ in rows:
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        want[d, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.encode_documents(docs, path).collect()) == want


def test_chat_round_trip(spark):
    odd = "</s>[INST] \\ \\1; <|end|>\n<|turn|>user\n"
    rows = [(1, 1, "assistant", odd), (1, 0, "us\ner", odd), (2, 0, None, None), (-7, 0, "user", "x"), (None, 3, "assistant", "y")]
    out = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), with_text=True).collect()}
    assert chat.read_back(out[1].formatted) == [("us\ner", odd), ("assistant", odd)]
    assert out[1].loss_chars == len(odd) and out[1].loss_sha256 == hashlib.sha256(odd.encode()).hexdigest()
    assert out[2].n_turns == 1 and out[2].loss_chars == 0 and out[None].loss_chars == 1


def test_templates_are_sandboxed_and_folded():
    for bad in ("{{ m.__class__ }}", "{{ f() }}", "{% import os %}", "{{ 'a' | eval }}", "{% if true %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    assert chat.fold(chat.parse("a{{ 'b' + 'c' }}{% if 1 == 2 %}x{% elif true %}d{% endif %}")) == ("block", [("text", "abcd")])


def test_topk_is_exact(spark):
    import math

    texts = [" ".join(f"t{(i * i + j * (i % 7 + 1)) % (13 + i % 29)}" for j in range(5 + i % 40)) for i in range(120)] + ["", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    queries = docs.filter("doc_id % 10 = 0 or doc_id > 118").withColumnRenamed("doc_id", "query_id")
    got = {}
    for r in topk.search(docs, queries, k=5, shard_bytes=1500).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.doc_id, round(r.score, 6)))
    tf = [Counter(WORD.findall(t or "")) for t in texts]
    mean, n = sum(sum(c.values()) for c in tf) / len(tf), len(tf)
    df = Counter(w for c in tf for w in c)
    for q, found in got.items():
        scores = []
        for d, c in enumerate(tf):
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in tf[q] if w in c)
            if s > 0:
                scores.append((-round(s, 9), d))
        assert sorted(found) == [(k + 1, d, pytest.approx(-s, abs=1e-5)) for k, (s, d) in enumerate(sorted(scores)[:5])]
    assert len(got) == 13


def _labelled(spark):
    plain = "the cat sat on the mat and looked at the quiet garden for a while"
    rows = [(i, (f"well you are a blorgh{i % 3} person, " if i % 4 == 0 else "") + plain + f" {i}" + (" $$$ %%% &&& ###" * 8 if i % 5 == 0 else ""), "en" if i % 2 else "de") for i in range(200)]
    docs = spark.createDataFrame(rows + [(900, None, None), (901, "", "en"), (None, "blorgh1", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0), int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_toxicity_learns_the_planted_stem(spark):
    docs, labels = _labelled(spark)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(200))
    assert got[900].predicted == 0 and got[900].score == got[901].score
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in range(200) if i % 4} | {900, 901}
    assert {r.score for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_quality_learns_the_planted_symbols(spark):
    docs, labels = _labelled(spark)
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    assert all(got[i].predicted == int(i % 5 != 0) for i in range(200))
    assert {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_languages(spark):
    en, de = "the quick brown fox jumps over the lazy dog and runs through the field ", "der schnelle braune fuchs springt über den faulen hund und läuft durch das feld "
    docs = spark.createDataFrame([(i, (en if i % 2 else de) * (1 + i % 5), "en" if i % 2 else "de") for i in range(40)] + [(100, None, "en"), (101, "123 !!", "en"), (102, "the dog and the fox", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify_languages(docs).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") for i in range(40))
    assert (got[100].lang_pred, got[101].lang_pred, got[102].lang_pred) == ("und", "und", "en")
    assert {r.lang_pred for r in langid.identify_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_suffix_automaton_finds_longest_matches():
    text = "abracadabra"
    auto = langid.suffix_automaton([ord(c) - 97 for c in text])
    for i in range(len(text)):
        for j in range(i, len(text)):
            state = 0
            for c in text[i : j + 1]:
                state = auto[state][ord(c) - 97]
    assert 1 not in auto[auto[0][1]]  # no bb


def test_minhash_tiles_of_many_blocks(spark, monkeypatch):
    """Families at similarities around the threshold, in tiles so small that a base has many."""
    rng = np.random.default_rng(5)
    texts = []
    for family in range(3):
        base = [f"f{family}w{k}" for k in range(120)]
        for _ in range(40):
            words = list(base)
            for k in rng.choice(120, rng.integers(0, 14), replace=False):
                words[k] = f"x{rng.integers(1000)}"
            texts.append(" ".join(words))
    order = rng.permutation(len(texts)).tolist()
    rows = [(i, texts[k]) for i, k in enumerate(order)]
    sets = [set(zip(t.split(), t.split()[1:])) for _, t in rows]
    want = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((want[i], want[j]))
                want = [low if c == high else c for c in want]
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 4)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2, percent=80).collect()}
    assert [got[i] for i in range(len(rows))] == want
    assert len(set(want)) > 3


def test_set_intersections_in_slices():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, n, 200)).astype(np.uint64) for n in (50, 400, 5000, 10**6)] * 20 + [np.zeros(0, np.uint64)]
    got = minhash._meet(sets[:30], sets[30:])
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[30:]] for a in sets[:30]]).all()
