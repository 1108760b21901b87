"""Benchmark items shorter than the masks, against brute force."""

import random

from rasterloom.llm import decontaminate


def test_short_items_are_found(spark):
    draw = random.Random(3)
    items = {100 * n + k: [f"i{n}x{k}x{j}" for j in range(n)] for n in range(1, 13) for k in range(2)}
    items[7] = ["same"] * 7
    texts = []
    for words in items.values():
        for misses in range(3):
            for _ in range(6):
                copy = list(words)
                for p in draw.sample(range(len(words)), min(misses, len(words))):
                    copy[p] = "zz"
                texts.append([*["pre"] * draw.randrange(3), *copy, *["post"] * draw.randrange(3)])
        texts += [words[1:], words[:-1], words[2:], words[:-2], [*words[:3], "more", *words[3:]], ["x", *words[1:], "y"]]

    def held(text, words):
        n = len(words)
        for start in range(1 - n, len(text)):
            same = [0 <= start + j < len(text) and text[start + j] == words[j] for j in range(n)]
            if sum(same) * 12 >= 10 * n:
                return True
        return False

    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    want = {(d, i) for d, t in enumerate(texts) for i, w in items.items() if held(t, w)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == want
    left = {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()}
    assert left == set(range(len(texts))) - {d for d, _ in want}
