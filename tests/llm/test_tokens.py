import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest_llm import frame, same
from tokenizers import Tokenizer

from clipquarry.llm import bpe, packing

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "b", "the", " ", "  ", "\n", "\t", "'s", "'", "é", "ß", "中", "🙂", "\xa0", " ", "́", "1", "2½", "<|endoftext|>"]
PARTS += ["<|startoftext|>", "<|STARTOFTEXT|>", "Σ", "ΑΣ", "İ", "K", "\x1c", "\r\n", "!!", "x" * 40, "͸", "Ɓ"]


def texts():
    draw = random.Random(3)
    odd = ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 30))) for _ in range(1500)]
    letters = [chr(c) for c in range(0x250)] + [f"A{chr(c)}b {chr(c)}{chr(c)}" for c in range(0x250)]
    return odd + letters + ["", " ", "a ", " a", "a\n", "a" * 3000, " " * 500, "To " * 900]


def library(path):
    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def test_ids_and_decoding_like_the_library():
    lib, own = library(BYTES), bpe.Bpe(BYTES)
    for text, ids in zip(texts(), own.encode(texts())):
        wanted = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == wanted, text
        assert own.decode(ids) == lib.decode(wanted, skip_special_tokens=False)
    for broken in ([0, 255, 200], [50256, 12000, 180]):
        assert own.decode(np.array(broken, "<u4").tobytes()) == lib.decode(broken, skip_special_tokens=False)


def test_word_ids_like_the_library():
    lib, own = library(WORDS), packing.WordIds(WORDS)
    for text, ids in zip(texts(), own.ids(texts())):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, text


def test_memory_bound_changes_nothing(monkeypatch):
    whole, words = bpe.Bpe(BYTES).encode(texts()), packing.WordIds(WORDS).ids(texts())
    monkeypatch.setattr(bpe, "CACHED", 50)
    monkeypatch.setattr(packing, "CACHED", 50)
    small, small_words = bpe.Bpe(BYTES), packing.WordIds(WORDS)
    for at in range(0, len(texts()), 100):
        assert small.encode(texts()[at : at + 100]) == whole[at : at + 100]
        assert small_words.ids(texts()[at : at + 100]) == words[at : at + 100]


@pytest.mark.parametrize("which", ["rows", "given_rows"])
def test_round_trip(spark, request, which):
    rows, lib = request.getfixturevalue(which), library(BYTES)
    want = []
    for doc_id, text in rows:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((doc_id, len(ids), digest, hashlib.sha256(back.encode()).hexdigest()))
    same(bpe.round_trip(frame(spark, rows), BYTES).collect(), want)


def test_id_columns(odd, rows):
    ids = bpe.encoded(odd, BYTES)
    same([(r.doc_id, r.text) for r in bpe.decoded(ids, BYTES).collect()], [(i, t or "") for i, t in rows])


@pytest.mark.parametrize("block", [1, 3, 256])
@pytest.mark.parametrize("which", ["rows", "given_rows"])
def test_packing(spark, request, which, block):
    rows, lib = request.getfixturevalue(which), library(WORDS)
    docs = frame(spark, rows).repartition(3)
    found = packing.packed(docs, WORDS, block=block).collect()
    ids = [(i, [*lib.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows]
    if len({i for i, _ in rows}) == len(rows):  # pieces tell their document only by its id
        own = dict(ids)
        by_doc = defaultdict(list)
        for r in found:
            by_doc[r.doc_id].append(r)
        assert by_doc.keys() == own.keys()
        for doc_id, parts in by_doc.items():
            at = 0
            for r in sorted(parts, key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(own[doc_id])
                piece = np.array(own[doc_id][at : at + r.length], "<u4").tobytes()
                assert r.ids_crc32 == zlib.crc32(piece)
                at += r.length
            assert at == len(own[doc_id])
    assert sum(r.length for r in found) == sum(len(x) for _, x in ids)
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append(r)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == 2048 or (at < 2048 and at & (at - 1) == 0)
        assert {r.sequence_length for r in parts} == {at}


def test_costs_are_balanced():
    draw = random.Random(4)
    work = [packing.Piece(n, 0, min(700, int(draw.expovariate(1 / 300)) + 1)) for n in range(1500)]
    total = sum(p.length for p in work)
    done, rest = packing.filled(work, total // 2048)
    assert all(sum(p.length for p in s) == 2048 for s in done)
    assert sum(p.length for p in rest) == total % 2048
    spent = sorted(sum(packing.cost(p.length) for p in s) for s in done)
    in_order, room = [0.0], 2048
    for p in work:
        size = p.length
        while size:
            take = min(size, room)
            in_order[-1] += packing.cost(take)
            size, room = size - take, room - take
            if not room:
                in_order.append(0.0)
                room = 2048
    spread = np.std(spent) / np.mean(spent)
    assert spread < 0.6 * np.std(in_order[:-1]) / np.mean(in_order[:-1])


def test_empty_table(none):
    assert bpe.round_trip(none, BYTES).count() == 0 and packing.packed(none, WORDS).count() == 0
