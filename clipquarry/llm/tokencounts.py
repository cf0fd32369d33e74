"""Token counts of byte-level BPE, with most words counted by looking them up as whole tokens.

Before any text is read, `proved` merges every string of the vocabulary and keeps those that come out as one token: a
word that is such a string has one token, without merging. Only other words are merged, each once per worker, up to a bound.

Texts are cut into words by the tokenizer's own rule. Runs of plain Latin text are cut here; what lies between them is cut by the
tokenizer's own code. Cuts between runs stand before a single blank between two plain characters, where a word always ends.

Null texts are empty and have no tokens. Special tokens that stand in a text are one token each. Repeated rows get equal
results, null ids stay null; extra columns are ignored, and an empty table gives an empty one. Only byte-level BPE files are taken, others raise.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clipquarry.llm.bpe import IN_LETTERS, LATIN, NEIGHBOURS, PLAIN_TEXT, PLAIN_WORDS, byte_letters
from clipquarry.llm.shared import pieces

LIMIT = 512  # tokens of a document within the limit
CACHED = 1_000_000  # merged words a worker remembers at most
LONG_WORD = 100  # characters from which a word's pairs are kept in a heap

PLAIN_CHARACTER = f"[!-~{LATIN}]"
RUN_ENDS = re.compile(f"(?<={PLAIN_CHARACTER})(?=[ \n]{PLAIN_CHARACTER})")

OUT = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


def specification(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    splitter, added = spec["pre_tokenizer"] or {}, spec["added_tokens"]
    plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
    byte_level = splitter.get("type") == "ByteLevel" and splitter["use_regex"] and not splitter["add_prefix_space"]
    if spec["normalizer"] or not plain or not byte_level or spec["model"].get("ignore_merges"):
        raise ValueError(f"not a plain byte-level tokenizer: {path}")
    return spec


def merge_ranks(spec: dict) -> dict[tuple[str, str], int]:
    merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
    return {(a, b): n for n, (a, b) in enumerate(merges)}


def merged_count(word: str, ranks: dict[tuple[str, str], int]) -> int:
    """How many tokens a word in byte letters is merged to: the pair of lowest rank first, of equal ones the leftmost."""
    if len(word) > LONG_WORD:
        return _merged_count_of_long(word, ranks)
    parts, none = list(word), len(ranks)
    known = ranks.get
    found = [known(p, none) for p in zip(parts, parts[1:])]
    while found:
        rank = min(found)
        if rank == none:
            break
        at = found.index(rank)
        parts[at] += parts.pop(at + 1)
        del found[at]
        if at:
            found[at - 1] = known((parts[at - 1], parts[at]), none)
        if at < len(found):
            found[at] = known((parts[at], parts[at + 1]), none)
    return len(parts)


def _merged_count_of_long(word: str, ranks: dict[tuple[str, str], int]) -> int:
    """The same with a heap of pairs, as looking at every pair for each merge would take a square of the length."""
    parts: list[str | None] = list(word)
    after = list(range(1, len(parts) + 1))
    ahead = list(range(-1, len(parts) - 1))
    waiting = [(ranks[p], at) for at, p in enumerate(zip(parts, parts[1:])) if p in ranks]
    heapq.heapify(waiting)
    left = len(parts)
    while waiting:
        rank, at = heapq.heappop(waiting)
        to = after[at]
        if parts[at] is None or to >= len(parts) or ranks.get((parts[at], parts[to])) != rank:
            continue  # one of the two has been merged since
        parts[at] += parts[to]
        parts[to] = None
        after[at] = after[to]
        left -= 1
        for a, b in ((ahead[at], at), (at, after[at])):
            if a >= 0 and b < len(parts):
                ahead[b] = a
                pair = ranks.get((parts[a], parts[b]))
                if pair is not None:
                    heapq.heappush(waiting, (pair, a))
    return left


@lru_cache(4)
def proved(path: str) -> tuple[str, ...]:
    """The vocabulary strings, in byte letters, that encode alone as one token. Special tokens are none of them."""
    spec = specification(path)
    ranks, special = merge_ranks(spec), {t["content"] for t in spec["added_tokens"]}
    return tuple(t for t in spec["model"]["vocab"] if t and t not in special and merged_count(t, ranks) == 1)


class Counts:
    """Token counts by one tokenizer file, with the words that a worker has met."""

    def __init__(self, path: str, whole: Iterable[str]):
        spec = specification(path)
        self.ranks = merge_ranks(spec)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = set(special)
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        letters = byte_letters()
        self.letters = {b: c for b, c in letters.items() if chr(b) != c}
        back = {c: b for b, c in letters.items()}
        # Words of plain runs are looked up as they stand in the text, others in byte letters after a mark.
        self.whole = {IN_LETTERS + t: 1 for t in whole}
        for token in whole:
            raw = bytes(back[c] for c in token)
            try:
                self.whole[raw.decode()] = 1
            except UnicodeDecodeError:
                pass  # a part of a character is no word of a plain run
        self.known = dict(self.whole)

    def words(self, text: str) -> list[str]:
        if PLAIN_TEXT.fullmatch(text) and not any(n in text for n in NEIGHBOURS):
            return PLAIN_WORDS.findall(text)
        runs: tuple[list[str], list[str]] = ([], [])
        for run in RUN_ENDS.split(text):
            odd = not PLAIN_TEXT.fullmatch(run) or any(n in run for n in NEIGHBOURS)
            runs[odd].append(run)
        plain, odd = ("".join(r) for r in runs)  # runs still end where the next one begins with a blank
        return PLAIN_WORDS.findall(plain) + [IN_LETTERS + w for w, _ in self.split(odd)]

    def learn(self, words: Iterable[str]) -> None:
        fresh = {w for w in words if w not in self.known}
        if len(self.known) - len(self.whole) + len(fresh) > CACHED:
            self.known = dict(self.whole)
            fresh = {w for w in words if w not in self.known}
        for word in fresh:
            letters = word[1:] if word[0] == IN_LETTERS else word.encode().decode("latin-1").translate(self.letters)
            self.known[word] = merged_count(letters, self.ranks)

    def count(self, text: str) -> int:
        total = 0
        for part in self.cut.split(text) if self.cut and any(t in text for t in self.special) else [text]:
            if part in self.special:
                total += 1
                continue
            words = self.words(part)
            try:
                total += sum(map(self.known.__getitem__, words))
            except KeyError:
                self.learn(words)
                total += sum(map(self.known.__getitem__, words))
        return total


@lru_cache(2)
def loaded(path: str, whole: tuple[str, ...]) -> Counts:
    return Counts(path, whole)


def counted(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each text. Nothing is shuffled; what goes to the tasks is the list of proved strings,
    which is no longer than the vocabulary."""
    whole = proved(path)

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = loaded(path, whole)
        for piece in pieces(batches):
            texts = pc.fill_null(piece.column("text"), "")
            tokens = np.array([counts.count(t) for t in texts.to_pylist()], np.int64)
            arrays = [piece.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(tokens), pa.array(tokens > limit)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(made, OUT)
