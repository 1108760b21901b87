"""Odd tables, hot rows and second opinions for the text operators."""

import random
import time

import numpy as np
import public_tokenizers
import pytest

from rasterloom.llm import bpe, chat, decontaminate, langid, pipeline, quality, topk, toxicity
from rasterloom.llm.common import PUNCTUATED, Words

DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def test_empty_tables(spark):
    none, labels, bench = (spark.createDataFrame([], s) for s in (DOCS, LABELS, "item_id long, text string"))
    assert toxicity.score_toxicity(none, labels).count() == 0
    assert quality.score_quality(none, labels).count() == 0
    assert langid.identify_languages(none).count() == 0
    assert bpe.encode_documents(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert decontaminate.contaminated(none, bench).count() == 0
    assert topk.search(none, none.withColumnRenamed("doc_id", "query_id")).count() == 0


def test_clashing_columns_are_ignored_or_carried(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", 0.5, 7, 1), (1, "a b c", "en", 0.5, 7, 1), (None, None, None, None, None, None)], DOCS + ", score double, shard int, kind int")
    bench = spark.createDataFrame([(5, "x y z w v u")], "item_id long, text string")
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == 3
    labels = spark.createDataFrame([], LABELS)
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    assert langid.identify_languages(docs).count() == 3
    assert topk.search(docs, docs.withColumnRenamed("doc_id", "query_id")).count() == 2


def test_long_texts(spark):
    text = " ".join(f"word{k % 977}" for k in range(300_000))
    docs = spark.createDataFrame([(3, text, "en"), (4, "ein kleiner satz", "de")], DOCS)
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 1)], LABELS)
    assert {r.doc_id for r in toxicity.score_toxicity(docs, labels).collect()} == {3, 4}
    assert all(0 <= r.score <= 1 for r in quality.score_quality(docs, labels).collect())
    assert all(0 <= r.score <= 1 for r in langid.identify_languages(docs).collect())


def test_order_and_distance_in_a_clause():
    lexicon = toxicity.Lexicon({"blorgh": 2.0}, {})

    def kinds(text):
        found = toxicity.clause_features(text, lexicon)
        return {k for k, v in zip(toxicity.KINDS, found) if v}

    assert kinds("you are a blorgh") == {"i@"}
    assert kinds("you are no blorgh") == {"i-@"}
    assert kinds("no and i mean it really you blorgh") == {"i@"}
    assert kinds("she said you are a blorgh") == {'i"@'}
    assert kinds("a blorgh she said") == {"i", "l"}  # the target comes after the hit
    assert kinds('the word "blorgh" is in the list of words') == {'i"'}
    assert kinds("you went to the house over the very long road to a blorgh") == {"i"}
    assert kinds("no. you blorgh") == {"i@"}
    assert kinds("i will kill you") == {"t", "l"}
    assert kinds("the cat sat") == set()


def test_the_composed_grammar_equals_its_parts_in_turn():
    rng = random.Random(4)
    parts = [toxicity.negation(), toxicity.reported_speech(), toxicity.aim()]
    for _ in range(400):
        word = [rng.choice("itynrqo") for _ in range(rng.randrange(1, 25))]
        want = list(word)
        for part in parts:
            state, out = 0, []
            for symbol in want:
                state, symbol = part.step(state, symbol)
                out.append(symbol)
            want = out
        state, got = 0, []
        for symbol in word:
            state, symbol = toxicity.GRAMMAR.step(state, symbol)
            got.append(symbol)
        assert got == want


def test_a_long_run_is_encoded_like_the_library_does_and_in_time():
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    coder, library = bpe.ForcedBoundaryBpe(path), tokenizers.Tokenizer.from_file(path)
    rng = random.Random(2)
    for n, letters in [(49, "ab"), (300, "aeiou"), (5000, "etaoin"), (100_000, "abcdefghijklmnopqrstuvwxyz"), (100_000, "a")]:
        text = "".join(rng.choice(letters) for _ in range(n))
        began = time.perf_counter()
        assert coder.encode(text) == library.encode(text, add_special_tokens=False).ids
        assert time.perf_counter() - began < 10


def test_scripts_beyond_the_alphabet_are_told_apart(spark):
    rng = random.Random(1)
    alphabet = {"zh": [chr(0x4E00 + 7 * k) for k in range(300)], "ko": [chr(0xAC00 + 28 * k) for k in range(300)], "ja": [chr(0x3042 + k) for k in range(70)], "en": list("etaoinshrdlu")}
    rows = [(40 * j + i, "".join(rng.choice(a) for _ in range(60)), name) for j, (name, a) in enumerate(alphabet.items()) for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r.lang_pred for r in langid.identify_languages(docs).collect()}
    assert all(got[i] == name for i, _, name in rows)


def test_phrases_equal_a_plain_parse_with_either_table():
    rng = random.Random(8)
    samples = {"a": "".join(rng.choice("abcd ") for _ in range(300)), "b": "".join(rng.choice("bcde ") for _ in range(300))}
    texts = ["".join(rng.choice("abcdef .") for _ in range(rng.randrange(1, 400))) for _ in range(30)]
    models = [langid.LanguageModel(samples), langid.LanguageModel(samples, dense=0)]
    classes = models[0].letters
    for text in texts:
        parts = classes(text).tolist()
        want = []
        for name in sorted(samples):
            held = classes(samples[name]).tolist()
            grams = {tuple(held[i:j]) for i in range(len(held)) for j in range(i + 1, min(len(held), i + 40) + 1)}
            count, now = 1, ()
            for c in parts:
                if now + (c,) in grams:
                    now += (c,)
                else:
                    count, now = count + 1, (c,) if (c,) in grams else ()
            want.append(count)
        for model in models:
            if parts:
                assert model.phrases([classes(text)])[0].tolist() == want


def test_queries_that_share_an_id_and_repeated_documents(spark):
    docs = spark.createDataFrame([(1, "apple pie"), (2, "cherry"), (2, "cherry"), (3, "plum"), (None, "apple"), (4, None), (5, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "apple"), (7, "cherry"), (8, "nothing here"), (9, ""), (None, "plum"), (10, None)], "query_id long, text string")
    got = sorted((r.query_id, r.rank, r.doc_id) for r in topk.search(docs, asked, k=3).collect())
    assert [q for q, *_ in got] == [7, 7, 7] and sorted(d for *_, d in got) == [1, 2, 2]


def test_shards_are_exact_whatever_the_pruning(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, rng.integers(1, 120)) if x < 5000) for _ in range(1500)]
    shard = topk.Shard(len(texts), 40.0)
    import pyarrow as pa

    shard.add(np.arange(len(texts)), pa.array(texts))
    shard.finish()
    df = dict(zip(shard.term.tolist(), shard.length.tolist()))
    for text in texts[::25]:
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        terms = topk._terms(Words(raw, np.array([0, len(raw)]), lower=True))[1]
        n = np.array([df[t] for t in terms.tolist()], dtype=np.int64)
        score = np.zeros(len(texts))
        for t, d in zip(terms.tolist(), n.tolist()):
            k = int(np.searchsorted(shard.term, t))
            at = slice(shard.begin[k], shard.begin[k] + shard.length[k])
            score[shard.doc[at]] += shard.impact[at] * np.log1p((len(texts) - d + 0.5) / (d + 0.5))
        value = np.round(score, 9)
        order = np.lexsort((np.arange(len(texts)), -value))
        want = [int(i) for i in order[:10] if score[i] > 0]
        ids, scores = shard.search(terms, n, 10)
        assert ids.tolist() == want and scores.tolist() == value[want].tolist()


def test_other_templates_are_read_back_or_refused(spark):
    own = "<s>{% for m in messages %}{% if m.role == 'user' %}[INST]{{ m.text | escape }}[/INST]{% else %}<|im_start|>{{ m.role | escape_line }}\n{{ m.text | escape }}<|im_end|>{% endif %}{% endfor %}</s>"
    said = [("user", "a [INST] b\\"), ("assistant", "</s>\n<|im_end|>"), ("user", ""), ("x\ny", "user")]
    assert chat.read_back(chat.compile_template(own)(said)[0], own) == said
    rows = spark.createDataFrame([(1, 0, "user", "hi"), (None, 0, "user", "a"), (None, 1, "user", "b")], "conv_id long, turn long, role string, text string")
    assert sorted(r.n_turns for r in chat.format_conversations(rows, own).collect()) == [1, 1, 1]
    for bad in ("{% for m in messages %}<|turn|>{{ m.role | escape }}\n{{ m.text | escape }}{% endfor %}", "{{ messages }}", "{% for m in messages %}<|turn|>{{ m.text }}<|end|>{% endfor %}"):
        with pytest.raises(chat.TemplateError):
            chat.format_conversations(rows, bad)


def test_decontamination_against_brute_force(spark):
    draw = random.Random(11)
    words = [f"v{k}" for k in range(40)]
    items = {k: [draw.choice(words) for _ in range(draw.randrange(3, 30))] for k in range(12)}
    items[99] = items[3]
    texts = {}
    for d in range(60):
        body = [draw.choice(words) for _ in range(draw.randrange(0, 40))]
        copy = list(items[draw.choice(sorted(items))])
        for p in draw.sample(range(len(copy)), min(len(copy), draw.randrange(4))):
            copy[p] = "other"
        at = draw.randrange(len(body) + 1)
        texts[d] = body[:at] + copy + body[at:]
    texts[60] = texts[1] + texts[1]  # ties: the first best place counts

    def best(text, item):
        found = None
        for start in range(1 - len(item), len(text)):
            same = [0 <= start + j < len(text) and text[start + j] == w for j, w in enumerate(item)]
            if len(item) < 12:
                fit = sum(same) if sum(same) * 12 >= 10 * len(item) else 0
            else:
                fit = max(sum(same[k : k + 12]) for k in range(len(item) - 11))
                fit = fit if fit >= 10 else 0
            if fit and (found is None or (-fit, max(start, 0)) < found):
                found = (-fit, max(start, 0))
        return found

    want = {(d, i, -f[0], f[1]) for d, t in texts.items() for i, x in items.items() if (f := best(t, x))}
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()], "item_id long, text string")
    for size in (8 << 20, 200):  # in one block, and in several
        got = {tuple(r) for r in decontaminate.contaminated(docs, bench, block_bytes=size).collect()}
        assert got == want
        left = {r.doc_id for r in decontaminate.drop_contaminated(docs, bench, block_bytes=size).collect()}
        assert left == set(texts) - {d for d, *_ in want}
    assert PUNCTUATED[32]


def test_quality_columns_equal_the_rules_in_numpy(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["alpha", "Beta", "$$$", "12", "x!"]) for _ in range(rng.randrange(1, 60))), "en") for i in range(150)]
    docs = spark.createDataFrame([*rows, (500, None, None), (501, "", None)], DOCS)
    labels = spark.createDataFrame([(i, int("$$$" not in t[: len(t) // 2]), 0) for i, t, _ in rows], LABELS)
    model = quality.fit(docs, labels)
    stats = {r[0]: np.array(r[1:], dtype=float)[None] for r in quality.with_statistics(docs).collect()}
    for r in quality.score_quality(docs, labels).collect():
        total = model.bias + sum(w for rule, w in zip(model.rules, model.weights) if rule.holds(stats[r.doc_id])[0])
        assert r.score == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-12) and r.predicted == int(r.score >= 0.3)


def test_pipeline_stages_against_brute_force(spark):
    """run() on the smallest tables: every stage by plain Python on what the one before kept."""
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "decontaminate", "bpe"]

    model = toxicity.fit(docs, spark.read.parquet(f"{data}/labels.parquet"))
    rows = [r for r in docs.collect() if model.score(r.text or "") < 0.5]
    clean = spark.createDataFrame(rows, docs.schema)
    assert sorted(r.doc_id for r in stages["toxicity"](spark, docs, data).collect()) == sorted(r.doc_id for r in rows)

    def near(a, b):  # one word inserted, dropped or replaced
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1:
            return False
        k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        return a[k + (len(a) == len(b)) :] == b[k + 1 :]

    # lines, the earliest of each kind first; only lines of equal halves can be near
    seen, halves, kept = set(), {}, {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        if r.text is None:
            kept[r.doc_id] = None
            continue
        lines, out = r.text.split("\n"), []
        for line in lines:
            words = tuple(line.split())
            hit = False
            if words:
                hit = words in seen
                if len(words) >= 8:
                    keys = {("a", words[:3]), ("z", words[-3:])}
                    hit = hit or any(near(words, o) for key in keys for o in halves.get(key, ()) if o != words)
                    for key in keys:
                        halves.setdefault(key, set()).add(words)
                seen.add(words)
            if not hit:
                out.append(line)
        text = "\n".join(out)
        if len(out) == len(lines) or text.strip():
            kept[r.doc_id] = text
    lines = stages["line_dedup"](spark, clean, data)
    assert {r.doc_id: r.text for r in lines.collect()} == kept

    sets = {}
    for d, t in kept.items():
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    label = {d: d for d in sets}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {d: low if c == high else c for d, c in label.items()}
    unique = stages["near_dedup"](spark, lines, data)
    assert sorted(r.doc_id for r in unique.collect()) == [d for d in ids if label[d] == d]

    free = stages["decontaminate"](spark, unique, data)
    gone = {r.doc_id for r in decontaminate.contaminated(unique, spark.read.parquet(f"{data}/benchmark.parquet")).collect()}
    want = {r.doc_id: r.text for r in unique.collect() if r.doc_id not in gone}
    assert {r.doc_id: r.text for r in free.collect()} == want

    library = pytest.importorskip("tokenizers").Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r.ids for r in pipeline.run(spark, data).collect()}
    assert got == {d: library.encode(t or "", add_special_tokens=False).ids for d, t in want.items()}


def test_factors_point_to_equal_words_in_earlier_documents(spark):
    from rasterloom.llm import substring_dedup

    rng = random.Random(9)
    words = [f"w{k}" for k in range(30)]
    texts = {1: [rng.choice(words) for _ in range(60)], 2: [rng.choice(words) for _ in range(50)]}
    texts[3] = ["x"] * 5 + texts[1][10:40] + texts[2][5:45] + ["y"]
    texts[4] = texts[3] + texts[1][:30]
    texts[5] = ["z"] * 40
    texts[6] = ["z"] * 25
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")
    window, gram = 12, 4
    found = substring_dedup.factors(docs, window, gram).collect()
    covered = {d: set() for d in texts}
    for r in found:
        assert r.length >= window and r.ref_doc < r.doc_id
        assert texts[r.doc_id][r.start : r.start + r.length] == texts[r.ref_doc][r.ref_start : r.ref_start + r.length]
        covered[r.doc_id].update(range(r.start, r.start + r.length))
    for d, t in texts.items():
        early = {tuple(o[i : i + window]) for e, o in texts.items() if e < d for i in range(len(o) - window + 1)}
        want = {k for i in range(len(t) - window + 1) if tuple(t[i : i + window]) in early for k in range(i, i + window)}
        assert covered[d] == want
    assert {(r.start, r.length, r.ref_doc, r.ref_start) for r in found if r.doc_id == 3} == {(5, 30, 1, 10), (35, 40, 2, 5)}
