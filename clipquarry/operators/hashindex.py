"""Groups of near copies that are kept from arrival to arrival.

A folder holds what is known: the signatures of all clips, an index of their frames by band value, and the groups. A
new arrival of clips looks its frames up in the index, is appended to it, and merges the groups it links. Old clips are not
compared with each other again and the old index is not shuffled: its tables are written in buckets of the columns they
are looked up by, so only the arrival moves to them.

Each table is partitioned by the number of the arrival. An arrival counts once its own line is written, after all its rows. Partitions
of one that stopped are not read by others, and are replaced when its number is tried again; a number that counts, or a lower one, is not
taken again. A clip comes as a whole in one arrival; later frames of a known clip are ignored, as are rows without a clip id, a
position or a hash.

The index holds the plain value of each band of each frame (five rows for 13 bits), and an arrival tries all flips, so what is
kept stays small and the threshold is free at every arrival. As all frames of the arrival are looked up, a pair is found whichever clip is longer.

Distances of a near pair of n frames add up to n times the threshold at most. So the first frames are within the threshold, or later ones
at one position are closer than that: if not, the sum would be one more at least. Frames after the first are looked up with a reach of one less.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipquarry.functions.phash import MATCH_MAX
from clipquarry.operators.hashes import HEAVY_ROWS, _band_values, _bands, _flips, _radii, _signatures
from clipquarry.operators.links import connected, landed
from clipquarry.skew import salted_join

BUCKETS = 64

# One side sends all flips here, of which narrow bands need few: at a threshold of 10, 135 rows for a clip's first frame and 69 for each
# other one, in place of 428 and 308 for 16 bits. Unrelated frames meet twice as often (1.0 % in place of 0.47 %).
INDEX_BITS = 13

VALUE = ["pos", "band", "value"]
# Columns of each table, and those it is bucketed by.
TABLES = {
    "frames": ("pos int, band int, value bigint, name binary, h bigint", VALUE),
    "signatures": ("name binary, signature array<bigint>", ["name"]),
    "members": ("clip_id bigint, name binary", ["clip_id"]),
    "labels": ("name binary, label binary", ["name"]),
}
MERGED = "label binary, into binary"
ARRIVED = "number bigint, merged string"


class Index:
    """The tables in `folder`, which driver and executors share. Band width and number of buckets stay as they were at the first arrival."""

    def __init__(self, spark: SparkSession, folder: str, band_bits: int = INDEX_BITS, buckets: int = BUCKETS):
        self.spark, self.folder, self.bands, self.buckets = spark, folder.rstrip("/"), _bands(band_bits), buckets
        tag = uuid.uuid4().hex
        self.named = {table: f"{table}_{tag}" for table in TABLES}
        counts = self.newest() is not None
        for table, (columns, by) in TABLES.items():
            spark.sql(
                f"create table {self.named[table]} ({columns}, arrival bigint) using parquet partitioned by (arrival) "
                f"clustered by ({', '.join(by)}) into {buckets} buckets location '{self.folder}/{table}'"
            )
            if counts:
                spark.sql(f"alter table {self.named[table]} recover partitions")

    def _arrivals(self) -> DataFrame:
        try:
            return self.spark.read.schema(ARRIVED).json(f"{self.folder}/arrivals/*")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], ARRIVED)

    def newest(self) -> tuple[int, str] | None:
        """Number of the last arrival that counts, and where its merges lie."""
        found = self._arrivals().agg(F.max(F.struct("number", "merged"))).first()[0]
        return None if found is None else (found[0], found[1])

    def table(self, name: str, upto: int | None) -> DataFrame:
        """Rows of all arrivals up to a number that count, and of that number itself."""
        rows = self.spark.table(self.named[name])
        # Arrivals that stopped and were overtaken have no line; there is one short row for each that counts.
        counted = [r[0] for r in self._arrivals().select("number").collect()]
        return rows.filter(F.col("arrival").isin([n for n in counted if upto is None or n < upto] + [n for n in [upto] if n is not None])).drop("arrival")

    def _merges(self) -> DataFrame:
        newest = self.newest()
        return self.spark.read.schema(MERGED).parquet(newest[1]) if newest else self.spark.createDataFrame([], MERGED)

    def _insert(self, name: str, rows: DataFrame, number: int) -> None:
        columns = [c.split()[0] for c in TABLES[name][0].split(", ")]
        view = f"{self.named[name]}_rows"
        # Dealt like the buckets, so that each is one file of an arrival.
        rows.select(*columns).repartition(self.buckets, *TABLES[name][1]).createOrReplaceTempView(view)
        self.spark.sql(f"insert overwrite table {self.named[name]} partition (arrival = {int(number)}) select * from {view}")
        self.spark.catalog.dropTempView(view)

    def sent(self, probes: DataFrame, threshold: int) -> DataFrame:
        """(a, pos, a_h, band, value): all that frames (name, pos, h) are looked up by, each row once."""
        later = _radii(threshold - 1, self.bands)
        masks = [
            (flips > later[b], f"struct({b} as band, {mask}L as mask)")
            for b, ((_, width), radius) in enumerate(zip(self.bands, _radii(threshold, self.bands)))
            for mask, flips in _flips(width, radius)
        ]
        # What later frames try too comes first.
        masks.sort(key=lambda m: m[0])
        tried = f"slice(array({', '.join(m for _, m in masks)}), 1, if(pos = 0, {len(masks)}, {sum(not first for first, _ in masks)}))"
        # The rows of an arrival may lie in one small file, and become many.
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = probes.repartition(parts, "name", "pos").selectExpr("name as a", "pos", "h as a_h", f"{_band_values(self.bands)} as bands", f"inline({tried})")
        return rows.selectExpr("a", "pos", "a_h", "band", "get(bands, band) ^ mask as value")

    def met(self, probes: DataFrame, number: int, threshold: int, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
        """(a, b): clips of `probes` (name, pos, h) and those of the index that have two first frames within the threshold, or two later ones of a
        position that are closer. No pair with a mean within the threshold is missed."""
        sent = self.sent(probes, threshold)
        index = self.table("frames", number).withColumnsRenamed({"name": "b", "h": "b_h"})
        # Counted where it lies, as the buckets are those of the key.
        hot = landed(index.groupBy(*VALUE).count().filter(F.col("count") >= heavy_rows).drop("count"), "hot")
        near = lambda df: df.filter(f"a <> b and bit_count(a_h ^ b_h) <= {threshold} - int(pos > 0)").select("a", "b")
        if hot.isEmpty():
            return near(sent.hint("merge").join(index, VALUE)).distinct()
        cold = near(sent.join(hot, VALUE, "left_anti").hint("merge").join(index, VALUE))
        some = index.join(hot, VALUE, "left_semi")
        crowd = near(salted_join(some, sent.join(hot, VALUE, "left_semi"), VALUE, ["b"], min_rows=heavy_rows))
        return cold.unionByName(crowd).distinct()

    def arrive(self, hashes: DataFrame, number: int, threshold: int = MATCH_MAX, heavy_rows: int = HEAVY_ROWS) -> bool:
        """Take in the clips of `hashes` (clip_id, frame_idx, phash); False, and nothing is written, if this or a later number counts already."""
        newest = self.newest()
        if newest is not None and newest[0] >= number:
            return False
        before = newest[0] if newest else None
        known = lambda table: self.table(table, before)
        whole = hashes.filter("clip_id is not null and frame_idx is not null and phash is not null")
        text = F.array_join(F.transform("signature", lambda h: h.cast("string")), ",")
        clips = _signatures(whole).select(F.col("clip_id").cast("bigint"), F.unhex(F.md5(text)).alias("name"), "signature")
        clips = landed(clips.join(known("members").select("clip_id"), "clip_id", "left_anti"), "clips")
        fresh = clips.groupBy("name").agg(F.first("signature").alias("signature"))
        fresh = landed(fresh.join(known("signatures").select("name"), "name", "left_anti"), "fresh")

        frames = fresh.select("name", F.posexplode("signature").alias("pos", "h"))
        self._insert("frames", frames.selectExpr("name", "pos", "h", f"posexplode({_band_values(self.bands)}) as (band, value)"), number)
        self._insert("signatures", fresh, number)
        self._insert("members", clips, number)

        left = fresh.select(F.col("name").alias("a"), F.col("signature").alias("x"))
        right = self.table("signatures", number).select(F.col("name").alias("b"), F.col("signature").alias("y"))
        compared = "least(size(x), size(y))"
        total = f"aggregate(sequence(0, {compared} - 1), 0L, (sum, i) -> sum + bit_count(get(x, i) ^ get(y, i)))"
        pairs = self.met(frames, number, threshold, heavy_rows).join(left, "a").hint("merge").join(right, "b")
        links = pairs.filter(f"{total} <= {int(threshold)} * {compared}").select("a", "b")

        # An old clip stands for its group.
        merges = self._merges()
        old = known("labels").join(merges, "label", "left").select("name", F.coalesce("into", "label").alias("label"))
        named = old.select(F.col("name").alias("b"), "label")
        ties = links.hint("merge").join(named, "b", "left").select("a", F.coalesce("label", "b").alias("b"))
        groups = landed(connected(ties, "a", "b", heavy_rows), "groups")

        node = groups.select(F.col("node").alias("name"), F.col("group").alias("label"))
        self._insert("labels", fresh.select("name").join(node, "name", "left").select("name", F.coalesce("label", "name").alias("label")), number)
        moved = node.select(F.col("name").alias("into"), F.col("label").alias("onto"))
        earlier = merges.join(moved, "into", "left").select("label", F.coalesce("onto", "into").alias("into"))
        olds = groups.join(fresh.select(F.col("name").alias("node")), "node", "left_anti").filter("node <> group")
        olds = olds.select(F.col("node").alias("label"), F.col("group").alias("into"))
        path = f"{self.folder}/merges/{uuid.uuid4().hex}"
        earlier.unionByName(olds).write.parquet(path)
        self.spark.range(1).select(F.lit(number).cast("bigint").alias("number"), F.lit(path).alias("merged")).write.json(
            f"{self.folder}/arrivals/{int(number)}"
        )
        return True

    def groups(self, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
        """(clip_id, group_id, group_clips) of all clips that have arrived: a group is named by its smallest clip."""
        labels = self.table("labels", None).join(self._merges(), "label", "left").select("name", F.coalesce("into", "label").alias("label"))
        members = salted_join(self.table("members", None), labels, ["name"], ["clip_id"], min_rows=heavy_rows).select("clip_id", "label")
        sizes = members.groupBy("label").agg(F.min("clip_id").alias("group_id"), F.count("*").alias("group_clips"))
        return salted_join(members, sizes, ["label"], ["clip_id"], min_rows=heavy_rows).select("clip_id", "group_id", "group_clips")
