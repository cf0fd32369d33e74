"""Packing documents into training sequences of balanced cost.

A piece costs a linear and a quadratic share of its length, as attention does inside a document. Each task fills its
sequences in blocks: pieces go in falling order to the cheapest sequence that has room for them, or are cut where no
sequence has. What a block leaves goes on to the next one, and a task's last tokens are laid out in sequences whose
lengths are powers of two, so nothing is padded. Documents never leave their task, so nothing is shuffled and a
task's memory is bounded by a block and its longest document.

A document is its ids and an end id. Null and empty texts are the end id alone. Repeated rows are packed as often as
they occur. Extra columns are ignored; an empty table gives no rows. Sequence ids are distinct over all tasks and the
same if a task is repeated.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from clipquarry.llm.shared import give_back, pieces

LENGTH = 2048
END_ID = 1
LINEAR = 1.0
QUADRATIC = 1 / LENGTH
BLOCK = 256  # sequences that are balanced together
CACHED = 500_000  # words whose ids a task remembers at most
TOGETHER = 64  # words in one call of the model

# Texts of these characters are split here: their classes and cases are the same in any Unicode version, and all of
# them stay in this range when lower-cased, but for U+0130.
LATIN = "A-Za-zÀ-ÖØ-öø-ſ"
PLAIN_TEXT = re.compile(rf"[!-~{LATIN} \t-\r]*")
PLAIN_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[0-9]|[!-/:-@\[-`{{-~]+")


class WordIds:
    """Ids of texts under a tokenizer file that lower-cases, drops white space and marks the ends of words.

    Plain texts are split here by the tokenizer's rule, and its model encodes each distinct word once; a task keeps
    the ids of words up to a bound. All other texts go through the tokenizer as they are.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        suffix = self.tokenizer.model.end_of_word_suffix
        if not suffix:
            raise ValueError(f"no mark at the ends of words: {path}")
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[n for t, n in vocab.items() if t.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        """Add the ids of words, each of one class of plain characters."""
        if len(self.known) + len(words) > CACHED:
            self.known = {}
        fresh = list(words)
        groups = [fresh[at : at + TOGETHER] for at in range(0, len(fresh), TOGETHER)]
        found = self.model.encode_batch_fast(groups, is_pretokenized=True, add_special_tokens=False)
        flat = np.array([i for e in found for i in e.ids], "<u4")
        ends = (np.flatnonzero(self.last[flat]) + 1) * 4
        if len(ends) != len(fresh):
            raise ValueError("words and their ends do not match")
        raw = flat.tobytes()
        self.known |= {w: raw[s:e] for w, s, e in zip(fresh, [0, *ends.tolist()], ends.tolist())}

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, 4 bytes each, low byte first."""
        lines, found, other = [], [], []
        for n, text in enumerate(texts):
            if PLAIN_TEXT.fullmatch(text) and "<|" not in text and "\u0130" not in text:
                lines.append(PLAIN_WORDS.findall(text.lower()))
            else:
                other.append(n)
                lines.append([])
            found.append(list(map(self.known.get, lines[-1])))
        gaps = [n for n, ids in enumerate(found) if None in ids]
        if gaps:
            missing = {w for n in gaps for w, ids in zip(lines[n], found[n]) if ids is None}
            self.learn(missing)
            for n in gaps:
                found[n] = [self.known[w] if ids is None else ids for w, ids in zip(lines[n], found[n])]
        out = [b"".join(ids) for ids in found]
        for n in other:
            out[n] = np.array(self.tokenizer.encode(texts[n], add_special_tokens=False).ids, "<u4").tobytes()
        return out


@lru_cache(2)
def loaded(path: str) -> WordIds:
    return WordIds(path)


class Piece(NamedTuple):
    doc: int  # number of the document in the task
    start: int
    length: int


def cost(length):
    return LINEAR * length + QUADRATIC * length * length


def filled(work: list[Piece], bins: int, length: int = LENGTH) -> tuple[list[list[Piece]], list[Piece]]:
    """Fill `bins` sequences of `length` exactly; what does not fit is returned. The pieces have to suffice."""
    room, spent = np.full(bins, length), np.zeros(bins)
    out: list[list[Piece]] = [[] for _ in range(bins)]
    rest = []
    for piece in sorted(work, key=lambda p: (-p.length, p.doc, p.start)):
        doc, start, size = piece
        while size:
            fits = np.where(room >= size, spent, np.inf)
            to = int(fits.argmin())
            if fits[to] == np.inf:
                any_room = np.where(room > 0, spent, np.inf)
                to = int(any_room.argmin())
                if any_room[to] == np.inf:
                    rest.append(Piece(doc, start, size))
                    break
            take = min(size, int(room[to]))
            out[to].append(Piece(doc, start, take))
            room[to] -= take
            spent[to] += cost(take)
            start, size = start + take, size - take
    return out, rest


OUT = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, "
    "sequence_length bigint"
)


def packed(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """One row per piece: its document, place there, and place in its sequence; `sequence_length` is padding-free."""
    if length & (length - 1):
        raise ValueError("length has to be a power of two")
    end = end_id.to_bytes(4, "little")

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 36
        held: dict[int, tuple[int | None, bytes]] = {}
        work: list[Piece] = []
        total, count = 0, 0

        def rows(sequences: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal sequence
            found = []
            for pieces_ in sequences:
                offset, size = 0, sum(p.length for p in pieces_)
                for doc, start, n in pieces_:
                    doc_id, ids = held[doc]
                    crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + n)])
                    found.append((doc_id, start, n, crc, len(ids) // 4, sequence, offset, size))
                    offset += n
                sequence += 1
            columns = zip(*found) if found else [[]] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in OUT.split(", ")])

        for piece in pieces(batches):
            texts = [t or "" for t in piece.column("text").to_pylist()]
            whole = []
            for doc_id, ids in zip(piece.column("doc_id").to_pylist(), loaded(path).ids(texts)):
                held[count] = (doc_id, ids + end)
                size = len(ids) // 4 + 1
                full = size - size % length
                whole += [[Piece(count, at, length)] for at in range(0, full, length)]
                if size > full:
                    work.append(Piece(count, full, size - full))
                    total += size - full
                count += 1
            if whole:
                yield rows(whole)
            while total >= block * length:
                # The longest pieces of a block's worth of documents, in the order they came.
                sizes = np.cumsum([p.length for p in work])
                cut = int(np.searchsorted(sizes, block * length)) + 1
                done, rest = filled(work[:cut], block, length)
                yield rows(done)
                work = [*rest, *work[cut:]]
                total -= block * length
            open_docs = {p.doc for p in work}
            held = {doc: held[doc] for doc in open_docs}
        if total >= length:
            done, work = filled(work, total // length, length)
            yield rows(done)
            total %= length
        while total:
            size = 1 << (total.bit_length() - 1)
            done, work = filled(work, 1, size)
            yield rows(done)
            total -= size
        # Idle workers stay for later stages, so a task leaves no memory behind.
        loaded(path).known = {}
        give_back()

    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return texts.mapInArrow(made, OUT)
