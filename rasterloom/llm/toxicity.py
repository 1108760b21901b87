"""Toxicity by a weighted grammar of finite-state transducers over clauses.

A text is cut into clauses. The words of a clause are read as symbols - insult, threat, target,
negation, report verb, quotation mark, other - and pass three transducers one after the other,
each with states of its own: negation marks hits among the SCOPE words after it, reported
speech marks hits behind a report verb or between quotation marks, and aim marks hits up to REACH
words after a target and tells of targets shortly after a hit. The three are composed into one
automaton before any text is read. So order and distance count: "you are no X" is a negated hit
and "no, you are a real X" is not, "she said X" is reported and "X, she said" is not.

The automaton's output, not words, is weighed: each kind of hit by its strength, summed over the
text's clauses, with weights from a logistic regression on labelled documents. Clauses without
a hit weigh nothing, so a clean text scores the fitted base rate of such texts however long it is.

Threat, target, negation and report words are fixed lists; the insult patterns (whole words, or
stems with any ending) and their strengths are learned from labelled documents, chosen one
after the other by the toxic documents that each newly explains and completed by those as frequent
and pure, at most `most` in all. Both fits read a bounded sample: at most `sample` documents of each
label, those of smallest xxhash64(doc_id). Patterns are counted and clauses read by the executors;
the driver receives counts, the toxic documents of the pure patterns, and features.

Defined results: null and empty texts have no clauses and score the base rate; without any
labelled document every score is 0; repeated rows repeat their score; rows with a null id are
scored but never learned from; other columns are ignored."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, stored

# Fixed word lists, in English, German, French and Spanish.
THREATS = frozenset("kill hurt destroy smash burn beat punish stab töten umbringen schlagen vernichten verletzen tuer frapper brûler détruire blesser matar golpear quemar destruir herir".split())
TARGETS = frozenset("you your yours yourself he she him her they them their everyone people du dich dir dein ihr euch sie ihn ihm tu toi te vous votre vos lui elle eux ils tú usted ustedes ellos ellas vosotros".split())
NEGATIONS = frozenset("not no never none neither nor isn't aren't don't doesn't won't nicht kein keine keinen nie niemals ne pas jamais aucun nunca jamás ningún ninguna tampoco".split())
REPORTS = frozenset("said says claimed claims wrote called reported quoted sagte sagt behauptete schrieb nannte dit disait écrit affirme appelé dijo dice escribió afirmó llamó".split())

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE = re.compile(r"[.!?;:\n]+|,\s")
_QUOTE = re.compile("[\"“”„«»]")

#: Words after a negation that it reaches, words between a target and its hit, and the other way round.
SCOPE, REACH, LATE = 3, 6, 3
#: Symbols: kinds of word, and a hit's marks as further letters of its symbol.
INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, OTHER, AIMED_LATE = "itynrqol"
NEGATED, REPORTED, AIMED = "-", '"', "@"
KINDS = [k + n + r + a for k in (INSULT, THREAT) for n in ("", NEGATED) for r in ("", REPORTED) for a in ("", AIMED)] + [AIMED_LATE]
_PLACE = {kind: i for i, kind in enumerate(KINDS)}


@dataclass(frozen=True)
class Transducer:
    """(state, symbol) -> (state, symbol); state 0 begins, and what is not listed stays as it is."""

    moves: dict[tuple[int, str], tuple[int, str]]

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.moves.get((state, symbol), (state, symbol))


def _hits(marks: str) -> list[str]:
    out = [INSULT, THREAT]
    for m in marks:
        out += [h + m for h in out]
    return out


def negation() -> Transducer:
    """State: the words that the last negation still reaches."""
    moves = {}
    for left in range(SCOPE + 1):
        moves[left, NEGATION] = (SCOPE, NEGATION)
        for symbol in (TARGET, REPORT, QUOTE, OTHER):
            moves[left, symbol] = (max(0, left - 1), symbol)
        for hit in _hits(""):
            moves[left, hit] = (max(0, left - 1), hit + NEGATED if left else hit)
    return Transducer(moves)


def reported_speech() -> Transducer:
    """States: 0 said by the writer, 1 behind a report verb, 2 between quotation marks."""
    moves = {(0, REPORT): (1, REPORT), (0, QUOTE): (2, QUOTE), (1, QUOTE): (2, QUOTE), (2, QUOTE): (0, QUOTE)}
    for hit in _hits(NEGATED):
        for state in (1, 2):
            moves[state, hit] = (state, hit + REPORTED)
    return Transducer(moves)


def aim() -> Transducer:
    """States: 1 to REACH words that the last target still reaches, REACH + 1 on words in which a hit waits for one."""
    moves = {}
    for state in range(REACH + LATE + 1):
        seen = 0 < state <= REACH
        waits = state > REACH
        calm = state - 1 if seen or state > REACH + 1 else 0
        moves[state, TARGET] = (REACH, AIMED_LATE if waits else TARGET)
        for symbol in (NEGATION, REPORT, QUOTE, OTHER):
            moves[state, symbol] = (calm, symbol)
        for hit in _hits(NEGATED + REPORTED):
            moves[state, hit] = (state - 1, hit + AIMED) if seen else (REACH + LATE, hit)
    return Transducer(moves)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that passes what the first puts out to the second; only pairs of states that can be reached."""
    symbols = sorted({s for _, s in first.moves} | {INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, OTHER})
    known, moves = {(0, 0): 0}, {}
    todo = [(0, 0)]
    while todo:
        pair = todo.pop()
        for symbol in symbols:
            one, middle = first.step(pair[0], symbol)
            two, out = second.step(pair[1], middle)
            if (one, two) not in known:
                known[one, two] = len(known)
                todo.append((one, two))
            moves[known[pair], symbol] = (known[one, two], out)
    return Transducer(moves)


GRAMMAR = reduce(compose, (negation(), reported_speech(), aim()))


class Lexicon:
    """The insult transducer: whole words, and stems with some ending, each with a weight."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        self.lengths = sorted({len(s) for s in stems}, reverse=True)
        starts = sorted({*words, *stems}, key=len, reverse=True)
        self.any = re.compile(r"(?<![^\W\d_])(?:" + "|".join(map(re.escape, starts)) + ")") if starts else None

    def weight(self, word: str) -> float:
        if word in self.words:
            return self.words[word]
        for n in self.lengths:
            if n < len(word) and word[:n] in self.stems:
                return self.stems[word[:n]]
        return 0.0


_THREAT_ANY = re.compile(r"(?<![^\W\d_])(?:" + "|".join(sorted(THREATS)) + r")(?![^\W\d_])")


_TOKEN = re.compile(_WORD.pattern + "|" + _QUOTE.pattern)
_FIXED = {w: k for words, k in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (THREATS, THREAT)) for w in words}


def clause_features(text: str, lexicon: Lexicon) -> np.ndarray:
    """The summed strength of each kind of hit, then the number of clauses with hits and the strongest clause's strength."""
    out = np.zeros(len(KINDS) + 2)
    low = text.lower()
    insults = bool(lexicon.any and lexicon.any.search(low))
    if not insults and not _THREAT_ANY.search(low):
        return out
    moves = GRAMMAR.moves
    for clause in _CLAUSE.split(low):
        if not ((insults and lexicon.any.search(clause)) or _THREAT_ANY.search(clause)):
            continue
        state, strength = 0, 0.0
        for word in _TOKEN.findall(clause):
            weight = lexicon.weight(word)
            symbol = INSULT if weight else _FIXED.get(word, OTHER if word[0].isalpha() else QUOTE)
            state, symbol = moves[state, symbol]
            if symbol in _PLACE:
                weight = weight or 1.0
                out[_PLACE[symbol]] += weight
                strength += weight if symbol != AIMED_LATE else 0.0
        if strength:
            out[len(KINDS)] += 1
            out[len(KINDS) + 1] = max(out[len(KINDS) + 1], strength)
    return out


Pattern = tuple[str, bool]
SUPPORT, PURITY = 3, 8.0


def learn_lexicon(where: dict[Pattern, set[int]], n_good: dict[Pattern, int], bad: int, good: int, most: int = 400) -> Lexicon:
    """Patterns that occur in toxic documents and hardly in others, chosen greedily.

    where has the toxic documents of each pattern, n_good the number of others; bad and good are
    the numbers of documents. A pattern is a whole word or a stem of four letters or more with an
    ending; each must newly explain SUPPORT toxic documents (one in 200 where those are more) and be
    PURITY times as frequent among them."""
    support = max(SUPPORT, bad // 200)
    weight = {p: math.log((len(x) + 0.1) / (bad + 1)) - math.log((n_good.get(p, 0) + 0.1) / (good + 1)) for p, x in where.items()}
    size = {p: len(x) for p, x in where.items() if weight[p] >= math.log(PURITY) and len(x) >= support}
    words: dict[str, float] = {}
    stems: dict[str, float] = {}
    done: set[int] = set()
    while size and len(words) + len(stems) < most:
        best = max(size, key=lambda p: (size[p] * min(weight[p], 5.0), not p[1], len(p[0]), p))
        gain = len(where[best] - done)
        if gain < size[best]:  # counted before others were chosen
            size[best] = gain
            if gain < support:
                del size[best]
            continue
        (stems if best[1] else words)[best[0]] = min(weight[best], 6.0)
        done |= where[best]
        del size[best]
    # what the chosen ones hide: patterns as pure and of the same order of frequency
    chosen = [*((w, False) for w in words), *((s, True) for s in stems)]
    least = max([2 * support, *([0.2 * min(len(where[p]) for p in chosen)] if chosen else [])])
    more = [p for p, x in where.items() if len(x) >= least and weight[p] >= 2 * math.log(PURITY)]
    for p in sorted(more, key=lambda p: (-len(where[p]), p[1], -len(p[0]), p)):
        held = [*words, *stems]
        if len(held) < most and not any(h.startswith(p[0]) for h in held) and not any(p[0].startswith(h) for h in stems):
            (stems if p[1] else words)[p[0]] = min(weight[p], 6.0)
    return Lexicon(words, stems)


def _patterns(word: str) -> list[Pattern]:
    """The word itself, if not very short, and its beginnings of four letters or more."""
    return [(word, False)] * (len(word) >= 3) + [(word[:n], True) for n in range(4, len(word))]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5, rounds: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last coefficient is the intercept."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (p - y)) + penalty * beta
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-5))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        size = np.abs(step).max()
        beta -= step / max(1.0, size)
        if size < 1e-6:
            break
    return beta


class ToxicityModel:
    def __init__(self, lexicon: Lexicon, beta: np.ndarray | None):
        self.lexicon, self.beta = lexicon, beta

    def score(self, text: str) -> float:
        if self.beta is None:
            return 0.0
        z = float(np.log1p(clause_features(text, self.lexicon)) @ self.beta[:-1] + self.beta[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _pattern_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, toxic, word, stem) of the distinct patterns of each text."""
    for b in batches:
        for i in range(b.num_rows):
            words = set(_WORD.findall((b.column(2)[i].as_py() or "").lower()))
            found = sorted({p for w in words for p in _patterns(w)})
            n = len(found)
            columns = [pa.array([b.column(k)[i].as_py()] * n, t) for k, t in ((0, pa.int64()), (1, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([w for w, _ in found], pa.string()), pa.array([s for _, s in found], pa.bool_())], names=["doc_id", "toxic", "word", "stem"])


def _feature_rows(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [clause_features(t.as_py() or "", lexicon) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "toxic", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, sample: int = 2000, most: int = 400) -> ToxicityModel:
    """Learn from labelled documents whose crc32(doc_id as text) mod `modulus` is not `remainder`."""
    known = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.filter(~held_out(F.col("doc_id"), modulus, remainder))
    rates = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    picked = None
    for label in (0, 1):
        some = known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = some if picked is None else picked.union(some)
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))  # 2 * sample short rows
    texts = stored(texts.select("doc_id", "toxic", "text"))
    have = {r[0]: r[1] for r in texts.groupBy("toxic").count().collect()}
    bad, good = have.get(1, 0), have.get(0, 0)
    if not bad or not good:
        return ToxicityModel(Lexicon({}, {}), None)
    patterns = texts.mapInArrow(_pattern_rows, "doc_id long, toxic int, word string, stem boolean")
    counts = patterns.groupBy("word", "stem").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    pure = counts.filter((F.col("bad") >= max(SUPPORT, bad // 200)) & (F.log((F.col("bad") + 0.1) / (bad + 1)) - F.log((F.col("good") + 0.1) / (good + 1)) >= math.log(PURITY)))
    pure = stored(pure)
    holders = patterns.filter("toxic = 1").join(F.broadcast(pure.select("word", "stem")), ["word", "stem"]).select("word", "stem", "doc_id").collect()  # pure patterns are few, and of toxic documents of the sample
    where: dict[Pattern, set[int]] = {}
    for word, stem, doc in holders:
        where.setdefault((word, stem), set()).add(doc)
    lexicon = learn_lexicon(where, {(r.word, r.stem): r.good for r in pure.collect()}, bad, good, most)
    rows = sorted(texts.select("doc_id", "toxic", "text").mapInArrow(_feature_rows(lexicon), "doc_id long, toxic int, x array<double>").collect())
    x, y = np.log1p(np.array([r[2] for r in rows])), np.array([float(r[1]) for r in rows])
    weight = np.where(y > 0, rates.get(1, 1) / bad, rates.get(0, 1) / good)
    return ToxicityModel(lexicon, fit_logistic(x, y, weight * len(y) / weight.sum()))


def _score(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.slice(at, 512)
                scores = [model.score(t.as_py() or "") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, sample: int = 2000) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (score >= 0.5)."""
    model = fit(docs, labels, modulus, remainder, sample)
    scored = docs.select("doc_id", "text").mapInArrow(_score(model), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "score", F.expr("int(score >= 0.5)").alias("predicted"))


def _clean(model: ToxicityModel, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.slice(at, 512)
                yield part.filter(pa.array([model.score(t.as_py() or "") < 0.5 for t in part.column(text)], pa.bool_()))

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, sample: int = 2000, source: DataFrame | None = None) -> DataFrame:
    """The documents that score under 0.5, with all their columns; source has the labelled texts."""
    model = fit(docs if source is None else source, labels, modulus, remainder, sample)
    return docs.mapInArrow(_clean(model, docs.columns.index("text")), docs.schema)
