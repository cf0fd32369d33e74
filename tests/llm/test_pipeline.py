import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from conftest_llm import frame, prose, same
from test_language import expected as plain_languages
from test_nearcopies import first_of_each
from test_repeats import covered, learn_tags
from tokenizers import Tokenizer

import corpus_pipeline
from clipquarry.llm import language, secrets
from clipquarry.llm.shared import landed


def more_rows():
    """Copies, near copies, shared passages, secrets and junk among ordinary documents."""
    base, passage = prose(70, 400), prose(71, 70)
    return [
        (100_001, base),
        (100_002, base),
        (100_003, base + " end."),
        (100_004, prose(72, 200) + " " + passage),
        (100_005, passage + " " + prose(73, 200)),
        (100_006, prose(74, 50) + " password=abcdefghijklmnop1 " + prose(75, 50)),
        (100_007, None),
        (100_008, "12 34 !!"),
        (100_009, "Это совсем другой язык и письмо"),
    ]


def test_stages_like_brute_force(spark, given):
    extra = spark.createDataFrame([(i, t, None, "x", len(t or "")) for i, t in more_rows()], given.schema)
    docs = given.unionByName(extra)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, landed(stage(spark, docs, ""), "stage")
        found[name] = docs
        if name != "packing":
            assert docs.dtypes == before.dtypes
    kept = {r[0] for r in plain_languages(rows) if r[2] != "und" and r[3] >= language.LEAST_SCORE}
    rows = [(i, t) for i, t, _ in rows if i in kept]
    same([(r.doc_id, r.text) for r in found["language"].collect()], rows)
    assert not {100_007, 100_008, 100_009} & kept and {100_001, 100_006} <= kept

    first = set(first_of_each(rows))
    rows = [(i, t) for i, t in rows if i in first]
    same([(r.doc_id, r.text) for r in found["near copies"].collect()], rows)
    assert 100_002 not in first

    learn_tags(spark, rows)
    cut = []
    for (i, _), (_, raw, cover) in zip(rows, covered(rows)):
        text, at = "", 0
        for char in raw.decode():
            size = len(char.encode())
            text += "" if all(cover[at : at + size]) else char
            at += size
        cut.append((i, text))
    rows = [(i, t) for i, t in cut if t]
    same([(r.doc_id, r.text, r.n_chars) for r in found["repeats"].collect()], [(i, t, len(t)) for i, t in rows])

    rows = [(i, secrets.cut_out(t, [(s, e) for _, s, e in secrets.spans(t, secrets.RULES)])) for i, t in rows]
    same([(r.doc_id, r.text, r.n_chars) for r in found["secrets"].collect()], [(i, t, len(t)) for i, t in rows])
    assert "abcdefghijklmnop1" not in dict(rows)[100_006]

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lib.no_truncation()
    pieces = defaultdict(list)
    for r in found["packing"].collect():
        pieces[r.doc_id].append(r)
    assert pieces.keys() == dict(rows).keys()
    for i, text in rows:
        ids, at = [*lib.encode(text, add_special_tokens=False).ids, 1], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_run_is_the_registered_query(spark, data):
    import __spark_entry__

    queries = __spark_entry__.queries()
    assert queries["pipeline"] is corpus_pipeline.run
    assert sorted(n.split("_")[0] for n in queries if n.startswith("op") and n[2].isdigit()) == sorted(f"op{n}" for n in range(1, 14))
    assert corpus_pipeline.run(spark, data).count() > 0


def test_odd_rows_go_through(spark, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            docs = landed(stage(spark, docs, ""), "stage")
        assert docs.count() >= 0
    assert frame(spark, []).count() == 0
