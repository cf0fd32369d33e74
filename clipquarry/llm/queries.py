"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from clipquarry.llm import bpe, fingerprints, language, licenses, packing, repeats, search, secrets, simhash, telephony, tokencounts, urls, whitening
from clipquarry.llm.shared import prepared
from clipquarry.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Where the public tokenizer files lie; every machine has them.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

# The rules that the query judges pages by.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def query(fn):
    @wraps(fn)
    def run(spark, root):
        return fn(prepared(spark), root)

    QUERIES[fn.__name__] = run
    return run


@query
def op1_fingerprints(spark, root):
    return fingerprints.beside_next(table(spark, root, "documents"))


@query
def op2_simhash(spark, root):
    groups = simhash.near_groups(table(spark, root, "documents"))
    return groups.withColumn("fingerprint", simhash.hex_form(groups["fp"])).drop("fp")


@query
def op9_urls(spark, root):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judged(table(spark, root, "pages"), rules)


@query
def op3_telephony(spark, root):
    return telephony.telephony(table(spark, root, "documents"))


@query
def op4_licenses(spark, root):
    return licenses.license_scan(table(spark, root, "documents")).drop("spans")


@query
def op6_secrets(spark, root):
    docs = table(spark, root, "documents")
    return secrets.summarised(secrets.findings(docs, secrets.scan(docs)))


@query
def op10_language(spark, root):
    docs = table(spark, root, "documents")
    return language.identified(docs, language.learnt(docs))


@query
def op5_bpe(spark, root):
    return bpe.round_trip(table(spark, root, "documents"), BYTE_BPE)


@query
def op8_packing(spark, root):
    return packing.packed(table(spark, root, "documents"), WORD_BPE)


@query
def op7_repeats(spark, root):
    return repeats.measured(table(spark, root, "documents"))


@query
def op11_token_counts(spark, root):
    return tokencounts.counted(table(spark, root, "documents"), BYTE_BPE)


@query
def op13_search(spark, root):
    return search.top_documents(table(spark, root, "documents"), table(spark, root, "benchmark"))


@query
def op12_whitening(spark, root):
    return whitening.whitened(table(spark, root, "embeddings"))
