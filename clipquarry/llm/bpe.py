"""Byte-pair encoding and decoding by a prefix-sharing walk over distinct words.

For every prefix of a word only its last token is kept: the encoding of a prefix is that of a shorter prefix plus one
token, and the token fits if the pair of the last two is what their joined text would be encoded to. Words are walked
in sorted order, which is the depth-first order of their trie, so the states of a shared prefix are computed once.
Which pairs fit is found by taking merges back at their border, once per pair.

Texts are cut into words by the tokenizer's own rule; a worker keeps the ids of the words it has seen, up to a bound.
Vocabulary and merges come from a public tokenizer file whose path is a parameter. Null texts are empty texts and have
no ids. Special tokens that stand in a text are one id each. Repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clipquarry.llm.shared import pieces

CACHED = 1_000_000  # words a worker remembers at most, and as many pairs

# Texts of these characters without neighbouring blanks are split here, as the classes of all of them are the same in
# any Unicode version; other texts are split by the tokenizer's own code, which takes longer.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
PLAIN_TEXT = re.compile(f"[!-~{LATIN} \n]*")
NEIGHBOURS = ("  ", "\n\n", " \n", "\n ")
PLAIN_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[!-/:-@\[-`{{-~]+|[ \n]")
IN_LETTERS = "\0"  # no plain word begins with it


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte: itself where it prints, else one after U+00FF in order."""
    prints = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + n) for n, b in enumerate(rest)}


class Bpe:
    """One tokenizer file of byte-level kind, with what has been computed so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, added = spec["model"], spec["added_tokens"]
        plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
        splitter = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or not plain or splitter.get("type") != "ByteLevel" or not splitter["use_regex"] or splitter["add_prefix_space"]:
            raise ValueError(f"not a plain byte-level tokenizer: {path}")
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {(a, b): n for n, (a, b) in enumerate(merges)}
        self.longest = max(map(len, self.ids))
        self.special = {t["content"]: t["id"] for t in added}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if added else None
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        letters = byte_letters()
        self.letters = {b: c for b, c in letters.items() if chr(b) != c}
        back = {c: b for b, c in letters.items()}
        self.raw = {n: bytes(back[c] for c in t) for t, n in self.ids.items()} | {n: t.encode() for t, n in self.special.items()}
        self.packed = {t: n.to_bytes(4, "little") for t, n in self.ids.items()}
        self.halves = {a + b: (a, b) for a, b in self.ranks}
        self.made = {a + b: n for (a, b), n in self.ranks.items()}
        self.whole: dict[str, bool] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}

    def merged(self, word: str) -> list[str]:
        """The tokens of a word by plain merging, lowest rank first."""
        parts = list(word)
        while len(parts) > 1:
            rank, at = min((self.ranks.get(p, len(self.ranks)), n) for n, p in enumerate(zip(parts, parts[1:])))
            if rank == len(self.ranks):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def look_at(self, pair: tuple[str, str]) -> bool:
        """Find out whether the second token can follow the first, or begin a word if the first is empty."""
        first, token = pair
        if token not in self.whole:
            self.whole[token] = self.merged(token) == [token]
        if len(self.pairs) >= CACHED:
            self.pairs.clear()
        self.pairs[pair] = self.whole[token] and (not first or self._stay_apart(first, token))
        return True

    def _stay_apart(self, a: str, b: str) -> bool:
        """Whether no merge joins the two tokens across their border.

        Merges are taken back, latest first. What then stands at the border must not have been merged before the
        merge that was taken back; of equal merges the left one came first.
        """
        ranks, made, halves = self.ranks, self.made, self.halves
        before = len(ranks)
        while True:
            if ranks.get((a, b), before) < before:
                return False
            left, right = made.get(a, -1), made.get(b, -1)
            if left < 0 and right < 0:
                return True
            if left > right:
                before, a = left, halves[a][1]
            else:
                before, b = right + 1, halves[b][0]

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """The ids of all these words, which are in byte letters."""
        out = {}
        ids, longest, pairs, packed = self.ids, self.longest, self.pairs, self.packed
        before, last = "", [""]  # last token of each prefix of the word before
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for start in range(end - longest if end > longest else 0, end):
                    token = word[start:end]
                    if token in ids:
                        pair = last[start], token
                        fits = pairs.get(pair)
                        if pairs[pair] if fits is None and self.look_at(pair) else fits:
                            last.append(token)
                            break
                else:
                    raise ValueError(f"no token ends at {end} in {word!r}")
            before, end, tokens = word, len(word), []
            while end:
                tokens.append(packed[last[end]])
                end -= len(last[end])
            out[word] = b"".join(reversed(tokens))
        return out

    def words_of(self, text: str) -> list[str]:
        """The words of a text: plain ones as they are, others in byte letters after a mark."""
        if PLAIN_TEXT.fullmatch(text) and not any(n in text for n in NEIGHBOURS):
            return PLAIN_WORDS.findall(text)
        return [IN_LETTERS + w for w, _ in self.split(text)]

    def learn(self, words: set[str]) -> None:
        """Make sure that the ids of all these words are known."""
        if len(self.words) + len(words) > CACHED:
            self.words = {}
        fresh = words - self.words.keys()
        letters = {w: w[1:] if w[0] == IN_LETTERS else w.encode().decode("latin-1").translate(self.letters) for w in fresh}
        ids = self.encode_words(set(letters.values()))
        self.words |= {w: ids[x] for w, x in letters.items()}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, 4 bytes each, low byte first."""
        split = []
        for text in texts:
            parts = self.cut.split(text) if self.cut and any(t in text for t in self.special) else [text]
            split.append([(part, None if part in self.special else self.words_of(part)) for part in parts])
        self.learn({w for parts in split for _, words in parts if words for w in words})
        known, out = self.words.__getitem__, []
        for parts in split:
            out.append(
                b"".join(
                    self.special[part].to_bytes(4, "little") if words is None else b"".join(map(known, words))
                    for part, words in parts
                )
            )
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no text are replaced by U+FFFD."""
        raw = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace")


@lru_cache(2)
def loaded(path: str) -> Bpe:
    return Bpe(path)


OUT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) with ids as ARRAY<INT> for each row."""

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            ids = loaded(path).encode([t or "" for t in piece.column("text").to_pylist()])
            flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
            ends = np.cumsum([0, *[len(i) // 4 for i in ids]], dtype=np.int32)
            arrays = [piece.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "ids"])

    return _texts(docs).mapInArrow(made, "doc_id bigint, ids array<int>")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give null."""

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            texts = [None if i is None else loaded(path).decode(np.array(i, "<u4").tobytes()) for i in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("bigint"), "ids").mapInArrow(made, "doc_id bigint, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Counts and digests of each text's ids and of the text decoded from them. Nothing is shuffled."""

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for piece in pieces(batches):
            ids = bpe.encode([t or "" for t in piece.column("text").to_pylist()])
            arrays = [
                piece.column("doc_id"),
                pa.array([len(i) // 4 for i in ids], pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                pa.array([hashlib.sha256(bpe.decode(i).encode()).hexdigest() for i in ids], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in OUT.split(", ")])

    return _texts(docs).mapInArrow(made, OUT)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
