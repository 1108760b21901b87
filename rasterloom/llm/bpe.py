"""BPE encoding and decoding by forced-boundary splitting.

The tokenizer file is read here and its steps are done here: special tokens are cut out, the
rest is normalised, split by the file's pattern and turned into byte letters. Two neighbouring
letters that stand together in no token of the vocabulary can never be merged, so a cut between
them is certain. Words are cut there; the fragments are encoded independently, once each, and
their ids are concatenated.

What a fragment or a word encodes to is remembered in tables of bounded size, so memory does not
grow with the number of distinct words. A Python worker keeps its coder, tables included, from
one task to the next. Decoding looks each id up and joins the tokens the way
the tokenizer file says (no decoder: by blanks).

Defined results: null text is treated as empty; the empty text has no ids and decodes to the
empty text; repeated rows give repeated results; other columns are ignored."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words, and fragments, in one table.
_MOST_REMEMBERED = 200_000
_LONGEST_REMEMBERED = 256
_NO_MERGE = 1 << 60
#: Fragments of more letters are merged by a heap, whose work grows with n log n.
_LONG = 48


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: printable bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b) if b in own else chr(spare))
        spare += b not in own
    return out


class ForcedBoundaryBpe:
    """Encoder and decoder of one tokenizer file of the word-end kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        if model["type"] != "BPE" or spec["decoder"] is not None or model["continuing_subword_prefix"] or model["byte_fallback"] or model["ignore_merges"]:
            raise ValueError("not a tokenizer file of the word-end kind")
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {self.vocab[a] << 32 | self.vocab[b]: (k, self.vocab[a + b]) for k, (a, b) in enumerate(pairs)}
        self.letters = byte_letters()
        self.inside = self._pairs_inside()
        self.steps = [(n["type"], n.get("pattern", {}).get("Regex"), n.get("content")) for n in spec["normalizer"]["normalizers"]]
        (split, level) = spec["pre_tokenizer"]["pretokenizers"]
        if split["behavior"] != "Removed" or not split["invert"] or level["use_regex"] or level["add_prefix_space"]:
            raise ValueError("not a pre-tokenizer of the word-end kind")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.fragments: dict[tuple[str, bool], tuple[int, ...]] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _pairs_inside(self) -> set[str]:
        """Pairs of letters that stand side by side inside some token."""
        out = set()
        for token in self.vocab:
            body = token[: -len(self.suffix)] if self.suffix and token.endswith(self.suffix) and token != self.suffix else token
            out.update(body[i : i + 2] for i in range(len(body) - 1))
        return out

    def normalise(self, text: str) -> str:
        for kind, pattern, content in self.steps:
            if kind == "NFC":
                text = text if text.isascii() else unicodedata.normalize("NFC", text)
            elif kind == "Replace":
                text = regex.sub(pattern, content, text)
            elif kind == "Lowercase":
                text = text.lower() if text.isascii() else "".join(c.lower() for c in text)
            else:
                raise ValueError(kind)
        return text

    def _merge(self, ids: list[int]) -> list[int]:
        """The ids of a fragment after all merges: the earliest in the file first, from the left."""
        if len(ids) > _LONG:
            return self._merge_long(ids)
        get, never = self.merges.get, (_NO_MERGE, 0)
        ranks = [get(x << 32 | y, never) for x, y in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low is never:
                break
            i = ranks.index(low)
            ids[i] = low[1]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 32 | ids[i], never)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 32 | ids[i + 1], never)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same for a long fragment: pairs wait in a heap by rank and place, places are linked."""
        get, gone = self.merges.get, -1
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = []
        for i in range(len(ids) - 1):
            if found := get(ids[i] << 32 | ids[i + 1]):
                heap.append((found[0], i, found[1], ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, merged, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= len(ids) or ids[j] != right:
                continue  # one of the two has been merged since
            ids[i], ids[j] = merged, gone
            after[i] = k = after[j]
            if k < len(ids):
                before[k] = i
                if found := get(merged << 32 | ids[k]):
                    heapq.heappush(heap, (found[0], i, found[1], merged, ids[k]))
            h = before[i]
            if h >= 0 and (found := get(ids[h] << 32 | merged)):
                heapq.heappush(heap, (found[0], h, found[1], ids[h], merged))
        return [x for x in ids if x != gone]

    def _fragment(self, letters: str, last: bool) -> tuple[int, ...]:
        ids = self.fragments.get((letters, last))
        if ids is None:
            parts = [*letters[:-1], letters[-1] + self.suffix] if last else letters
            # a letter without a token of its own is left out, as the tokenizer does without an unknown token
            ids = tuple(self._merge([self.vocab[x] for x in parts if x in self.vocab]))
            if len(self.fragments) >= _MOST_REMEMBERED:
                self.fragments.clear()
            if len(letters) <= _LONGEST_REMEMBERED:
                self.fragments[letters, last] = ids
        return ids

    def encode_word(self, word: str) -> tuple[int, ...]:
        """The ids of one word of the pattern: cut where no token can reach across."""
        letters = "".join([self.letters[b] for b in word.encode("utf-8")])
        out: list[int] = []
        begin = 0
        for i in range(1, len(letters)):
            if letters[i - 1 : i + 1] not in self.inside:
                out += self._fragment(letters[begin:i], False)
                begin = i
        return (*out, *self._fragment(letters[begin:], True))

    def _encode_plain(self, text: str, out: list[bytes]) -> None:
        """Add the ids of text without special tokens, four bytes each.

        Words are remembered in two tables: a full one becomes the older, and what is asked for
        there moves to the new one, so frequent words stay."""
        get = self.words.get
        for word in self.pattern.findall(self.normalise(text)):
            known = get(word)
            if known is None:
                known = self.older.get(word)
                if known is None:
                    known = np.array(self.encode_word(word), dtype="<u4").tobytes()
                if len(self.words) >= _MOST_REMEMBERED:
                    self.older, self.words = self.words, {}
                    get = self.words.get
                if len(word) <= _LONGEST_REMEMBERED:
                    self.words[word] = known
            out.append(known)

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for k, part in enumerate(self.cut_special.split(text) if self.cut_special else [text]):
            if k % 2:
                out.append(np.array([self.special[part]], dtype="<u4").tobytes())
            elif part:
                self._encode_plain(part, out)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])


@lru_cache(maxsize=2)
def coder_of(path: str) -> ForcedBoundaryBpe:
    """The coder of a tokenizer file, once in each Python worker."""
    return ForcedBoundaryBpe(path)


def _encode(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(path)
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                n, ids_sha, text_sha, ids = [], [], [], []
                for text in part.column(1):
                    raw = coder.encode_bytes(text.as_py() or "")
                    own = np.frombuffer(raw, dtype="<u4")
                    n.append(len(own))
                    ids_sha.append(hashlib.sha256(raw).hexdigest())
                    text_sha.append(hashlib.sha256(coder.decode(own.tolist()).encode()).hexdigest())
                    if with_ids:
                        ids.append(own.astype(np.int32))
                arrays = [part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    arrays.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def encode_documents(docs: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked, the ids.

    tokenizer is the path of the tokenizer file on every machine."""
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_encode(tokenizer, with_ids), kind)
