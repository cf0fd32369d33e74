"""Secret scans over every version of every file, through a ledger of contents.

A version's content is addressed by its SHA-256. The ledger has a row for each content and rule version that were
scanned, with what was found, so a content is scanned once however many paths and dates it has, and again only for
rules that came later. Findings are joined back to all paths.

Null texts are empty texts. Repeated rows get equal results; null ids are allowed. Spans are code points of the
whole match. Extra columns stay out of the result; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipquarry.llm.shared import landed
from clipquarry.skew import salted_join


class Rule(NamedTuple):
    kind: str
    version: int  # the rule version that brought it
    pattern: str
    flags: int = 0
    value: int = 0  # the group whose length counts
    least: int = 0
    hints: tuple[str, ...] = ()  # one of these is in the lower-cased text if anything matches
    mixed: bool = False  # the value needs upper and lower case letters and digits


# What counts as a secret. Where a pattern asks for a least length by itself, its matches are those of
# the plain pattern that are long enough, as a run of one class is matched whole.
RULES = [
    Rule(
        "assign",
        1,
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        re.IGNORECASE | re.ASCII,
        2,
        12,
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", hints=("akia",)),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
    Rule("key", 2, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hints=("private key",)),
    Rule("jwt", 2, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hints=("eyj",)),
    Rule("forge", 2, r"gh[pousr]_[A-Za-z0-9]{36,}", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("chat", 2, r"xox[abprs]-[A-Za-z0-9-]{10,}", hints=("xox",)),
    Rule("random", 2, r"[A-Za-z0-9+/]{40,}", mixed=True),
]
BASE = ("assign", "access", "hex")
REDACTED = "[secret]"

# Unseen contents whose addresses go to every task; about 100 bytes each.
BROADCAST_PATHS = 100_000

# Contents that a task remembers, so that it scans one that lies under many null ids once.
REMEMBERED = 10_000


def spans(text: str, rules: Iterable[Rule]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all matches, by start and then in the order of the rules."""
    found, low = [], text.lower()
    for n, rule in enumerate(rules):
        if rule.hints and not any(h in low for h in rule.hints):
            continue
        for match in re.compile(rule.pattern, rule.flags).finditer(text):
            value = match[rule.value]
            if len(value) >= rule.least and (not rule.mixed or all(re.search(c, value) for c in ("[a-z]", "[A-Z]", "[0-9]"))):
                found.append((match.start(), n, rule.kind, match.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256))


LEDGER = "blob binary, version int, spans array<struct<kind:string,start:int,stop:int>>"


def unseen_texts(docs: DataFrame, ledger: DataFrame | None, rules: list[Rule], broadcast_paths: int) -> DataFrame:
    """(blob, text, versions): each content that the ledger lacks under some rule versions, from one of its paths; under null
    ids from all of them."""
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    paths = rows.select("doc_id", blob_of(F.col("text")).alias("blob"))
    unseen = (
        paths.groupBy("blob")
        .agg(F.min("doc_id").alias("from_id"))
        .withColumn("version", F.explode(F.array(*[F.lit(r) for r in sorted({r.version for r in rules})])))
    )
    if ledger is not None:
        unseen = unseen.join(ledger.select("blob", "version").distinct(), ["blob", "version"], "left_anti")
    todo = unseen.groupBy("blob").agg(F.max("from_id").alias("from_id"), F.array_sort(F.collect_set("version")).alias("versions"))

    hint = "shuffle_hash"
    if ledger is not None:
        todo = landed(todo, "unseen")
        hint = "broadcast" if todo.count() <= broadcast_paths else hint
    texts = rows.withColumn("blob", blob_of(F.col("text"))).alias("t")
    same = (F.col("t.blob") == F.col("d.blob")) & F.col("t.doc_id").eqNullSafe(F.col("d.from_id"))
    return texts.join(todo.alias("d").hint(hint), same).select("t.blob", "t.text", "d.versions")


def scan(
    docs: DataFrame, ledger: DataFrame | None = None, rules: list[Rule] = RULES, broadcast_paths: int = BROADCAST_PATHS
) -> DataFrame:
    """The ledger with the contents of docs (doc_id, text) added, as far as it did not have them under these rules.

    `ledger` is what an earlier call returned, if any. Counting contents needs their addresses only. With a ledger, while the new
    contents are `broadcast_paths` at most (counted), their addresses go to every task, which scans where the texts lie, and no text
    moves. More of them, and a first scan, meet the texts by shuffle.
    """
    versions = sorted({r.version for r in rules})
    picked = unseen_texts(docs, ledger, rules, broadcast_paths)

    def scanned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
        by_version = {v: [r for r in rules if r.version == v] for v in versions}
        seen: set[bytes] = set()
        for batch in batches:
            blobs, numbers, found = [], [], []
            columns = [batch.column(c) for c in ("blob", "text", "versions")]
            for i in range(batch.num_rows):
                blob = columns[0][i].as_py()
                if blob in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(blob)
                text, open_versions = columns[1][i].as_py(), columns[2][i].as_py()
                for v in open_versions:
                    blobs.append(blob)
                    numbers.append(v)
                    found.append([{"kind": k, "start": s, "stop": e} for k, s, e in spans(text, by_version[v])])
            arrays = [pa.array(blobs, pa.binary()), pa.array(numbers, pa.int32()), pa.array(found, kind)]
            yield pa.RecordBatch.from_arrays(arrays, names=["blob", "version", "spans"])

    new = picked.mapInArrow(scanned, LEDGER).dropDuplicates(["blob", "version"])
    return landed(new if ledger is None else ledger.unionByName(new), "ledger")


def by_blob(ledger: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(blob, spans) of the contents in which these rules found something; spans by start, then in the order of rules."""
    order = {r.kind: n for n, r in enumerate(rules)}
    place = F.element_at(F.create_map(*[F.lit(x) for pair in order.items() for x in pair]), F.col("s.kind"))
    hits = ledger.filter(F.col("version").isin({r.version for r in rules})).select("blob", F.explode("spans").alias("s"))
    hits = hits.filter(F.col("s.kind").isin(list(order)))
    sortable = F.struct(F.col("s.start").alias("start"), place.alias("place"), F.col("s.stop").alias("stop"), F.col("s.kind").alias("kind"))
    return hits.groupBy("blob").agg(F.array_sort(F.collect_list(sortable)).alias("spans"))


def findings(docs: DataFrame, ledger: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, blob, spans) for every row of docs, from the ledger; spans may be empty. A content with very many paths
    is spread over tasks."""
    paths = landed(docs.select(F.col("doc_id").cast("bigint"), blob_of(F.col("text").cast("string")).alias("blob")), "paths")
    found = by_blob(ledger, rules)
    kind = found.schema["spans"].dataType.simpleString()
    joined = salted_join(paths, found, ["blob"], ["doc_id"], "left")
    return joined.select("doc_id", "blob", F.coalesce("spans", F.array().cast(kind)).alias("spans"))


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def summarised(found: DataFrame) -> DataFrame:
    """Counts of the base kinds and the lists of spans."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    counts = [of(kind).alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))


def cut_out(text: str, found: Iterable[tuple[int, int]], mark: str = REDACTED) -> str:
    """The text with spans, ordered by start, replaced; overlapping ones together."""
    out, at = [], 0
    for start, end in found:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, ledger: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """docs with all columns, what the ledger has found in their texts replaced. Null texts stay null."""

    @F.pandas_udf("string")
    def made(texts: pd.Series, spans: pd.Series) -> pd.Series:
        pairs = zip(texts, spans)
        return pd.Series([t if s is None else cut_out(t, [(x["start"], x["stop"]) for x in s]) for t, s in pairs], dtype=object)

    blob = blob_of(F.col("text").cast("string")).alias("blob")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("path"), blob)
    rows = salted_join(rows, by_blob(ledger, rules), ["blob"], ["path"], "left", counted=landed(docs.select(blob), "blobs"))
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(made("row.text", "spans"))
    return rows.select(F.col("row").withField("text", text).alias("row")).select("row.*")
