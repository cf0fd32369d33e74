import numpy as np
import public_tokenizers
import pytest
from conftest_llm import frame, same
from test_tokens import library, texts

from clipquarry.llm import tokencounts

BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def counts():
    return tokencounts.Counts(BYTES, tokencounts.proved(BYTES))


def test_like_the_library(counts):
    lib = library(BYTES)
    mixed = ["".join(p) for p in zip(texts(), texts()[7:], texts()[31:])]
    lined = ["\n".join(p) for p in zip(texts()[::3], texts()[1::3])] + [" ".join(texts()[:600])]
    for text in [*texts(), *mixed, *lined]:
        assert counts.count(text) == len(lib.encode(text, add_special_tokens=False).ids), text


def test_proved_strings_are_one_token_each():
    lib, whole = library(BYTES), tokencounts.proved(BYTES)
    vocabulary = {t for t in lib.get_vocab()} - {"<|endoftext|>"}
    assert set(whole) <= vocabulary and len(whole) > 50_000
    model = lib.model
    alone = {t for t in vocabulary if len(model.tokenize(t)) == 1}
    assert set(whole) == alone


def test_only_unproved_words_are_merged(monkeypatch):
    made = []
    plain = tokencounts.merged_count
    monkeypatch.setattr(tokencounts, "merged_count", lambda word, ranks: made.append(word) or plain(word, ranks))
    counts = tokencounts.Counts(BYTES, tokencounts.proved(BYTES))
    made.clear()
    assert counts.count("the house of the blorptastic house") == 5 + counts.known[" blorptastic"]
    assert made == ["Ġblorptastic"]


def test_bounded_memory_changes_nothing(monkeypatch, counts):
    wanted = [counts.count(t) for t in texts()]
    monkeypatch.setattr(tokencounts, "CACHED", 40)
    small = tokencounts.Counts(BYTES, tokencounts.proved(BYTES))
    assert [small.count(t) for t in texts()] == wanted


def test_heap_merges_alike(monkeypatch, counts):
    words = [w for t in texts() for w in counts.words(t) if not w.startswith(tokencounts.IN_LETTERS) and w.isascii() and w.isalpha()]
    wanted = [tokencounts.merged_count(w, counts.ranks) for w in words]
    monkeypatch.setattr(tokencounts, "LONG_WORD", 0)
    assert [tokencounts.merged_count(w, counts.ranks) for w in words] == wanted


def test_very_long_words(counts):
    lib, draw = library(BYTES), np.random.default_rng(1)
    for text in ("a" * 50_000, "".join(draw.choice(list("etaoin"), 60_000)), "中文" * 20_000):
        assert counts.count(text) == len(lib.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("which", ["rows", "given_rows"])
def test_counted(spark, request, which):
    rows, lib = request.getfixturevalue(which), library(BYTES)
    sizes = [(i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    same(tokencounts.counted(frame(spark, rows), BYTES).collect(), [(*r, r[2] > 512) for r in sizes])


def test_empty_and_other_files(none):
    assert tokencounts.counted(none, BYTES).collect() == []
    with pytest.raises(ValueError):
        tokencounts.counted(none, public_tokenizers.path("word_bpe_49k.json"))
