"""What several operators need: a shared folder for intermediate tables and Arrow batches of bounded size."""

from __future__ import annotations

import ctypes
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Text bytes that one vectorised step handles at most, unless a single text is longer.
PIECE_BYTES = 1 << 20

# Bytes in a batch between Spark and Python; texts may be long, and a worker holds a batch in several forms.
BATCH_BYTES = 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

ROOT = Path(__file__).resolve().parents[2]

LAST_ID = 2**63 - 1
TAGS = 2**62

# What `keyed` tells rows apart by.
KEY = ["did", "tag", "tie"]
KEY_TYPES = "did bigint, tag bigint, tie bigint"


def prepared(spark: SparkSession) -> SparkSession:
    """The session with batches of bounded size, and with this package where workers find it.

    Only queries and pipeline stages call this; operators leave the session as it is.
    """
    size = spark.conf.get(BATCH_SETTING, None)
    if size is None or not size.rstrip("b").isdigit() or int(size.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    found = [Path.cwd(), *[Path(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]]
    if ROOT not in [p.resolve() for p in found] and id(spark.sparkContext) not in SHIPPED:
        copy = shutil.make_archive(f"{tempfile.mkdtemp(prefix='package-')}/package", "zip", ROOT, "clipquarry")
        spark.sparkContext.addPyFile(copy)
        SHIPPED.add(id(spark.sparkContext))
    return spark


SHIPPED: set[int] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`, which driver and executors share. A local session without that
    setting gets a folder of its own; a cluster has to name one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="landed-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def landed(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: the lineage ends there, and what reads it
    twice computes it once. Unlike a cached table it survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with (did, tag, tie), which are never null, tell rows apart and order them: the id, null ids last, and a hash of
    the text. Tags from `TAGS` on mean a null id. Null texts become empty.

    The hash has 62 bits; null ids, which may be very many, have another 64 in `tie`, which is 0 for all others, as it
    goes with every row that is shuffled. As the planner knows that none is null, joins on them read one and the same shuffle. Different texts of a million rows of one id share a key with a chance of 1e-7.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    absent = F.col("doc_id").isNull()
    tag = F.coalesce(F.pmod(F.xxhash64(text), F.lit(TAGS)), F.lit(0)) + F.when(absent, F.lit(TAGS)).otherwise(F.lit(0))
    tie = F.when(absent, F.xxhash64(F.lit(1), text)).otherwise(F.lit(0))
    did = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID))
    return docs.withColumns({"text": text, "did": did, "tag": tag.cast("bigint"), "tie": tie.cast("bigint")})


def boxed(docs: DataFrame) -> DataFrame:
    """(did, tag, tie, row): the key of each row beside all its columns in one, so that no name can clash."""
    key = keyed(docs.select("doc_id", "text", F.struct("*").alias("row")))
    return key.select(*KEY, "row")


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that `column` has `limit` bytes at most in each, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def gathered(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Join batches to tables of about `limit` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= limit:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def give_back() -> None:
    """Return memory that was freed to the system, as far as it lets us."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column in one array, and where each row starts and the last one ends. Null is empty."""
    column = pc.fill_null(column, "")
    wide = column.cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    at = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return flat, at - at[0]


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Regroup batches that are sorted by `keys` so that no key is split between two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changes = np.zeros(batch.num_rows, bool)
        for key in keys:
            values = batch.column(key).to_numpy(zero_copy_only=False)
            changes[1:] |= values[1:] != values[:-1]
            if held and held[-1].column(key)[-1] != batch.column(key)[0]:
                changes[0] = True
        cuts = np.flatnonzero(changes)
        if not len(cuts):
            held.append(batch)
            continue
        head, tail = batch.slice(0, cuts[-1]), batch.slice(cuts[-1])
        if held or head.num_rows:
            yield pa.Table.from_batches([*held, head] if head.num_rows else held)
        held = [tail]
    if held:
        yield pa.Table.from_batches(held)
