"""Comparing clips by the perceptual hashes of their frames.

Hash rows are (clip_id, frame_idx, phash), one for each frame of a clip; `frame_idx` is its 0-based position. Clips
may have any number of frames; two clips are compared frame by frame up to the shorter one's end.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipquarry.functions.phash import CORNER, FRAME_SIDE, MATCH_MAX, cosine_basis, match_verdict, phash64, verdict_detail
from clipquarry.functions.semantics import round_digits
from clipquarry.skew import HEAVY_ROWS, heavy_keys, salted_join

# Fixed values.
NO_FRAMES = "No frames hashed"
NOT_COMPARABLE = "No comparable frames"

HASH_BITS = 64

# Bits of a hash that near duplicates meet on. Fewer bits need fewer rows per frame, more bits bring fewer
# unrelated frames together.
BAND_BITS = 16

# A band value that so many signatures share at one position is common; near duplicates are looked for at other frames.
COMMON_ROWS = 10_000

# How many times the rows of the threshold's own reach a further one may send.
MORE_ROWS = 8


def hash_frames(frames: DataFrame) -> DataFrame:
    """Replace the gray values by their hash: one batched pass, no shuffle."""
    return frames.withColumn("phash", phash64("gray")).drop("gray")


def hash_frames_relational(spark: SparkSession, frames: DataFrame, keys: list[str]) -> DataFrame:
    """The same hash in joins and sums only.

    Pixels meet the broadcast cosine rows of their column and are summed per frame line, then the lines
    meet the cosines of their height and are summed per frame. Both sums combine before the shuffle.
    """
    basis = cosine_basis()
    waves = [f"c{u}" for u in range(CORNER)]
    rows = [(x, *[float(v) for v in basis[:, x]]) for x in range(FRAME_SIDE)]
    cosines = F.broadcast(spark.createDataFrame(rows, ["at", *waves]))

    pixels = frames.select(*keys, F.posexplode("gray").alias("at", "v")).select(
        *keys, F.expr(f"at div {FRAME_SIDE}").alias("y"), F.expr(f"at % {FRAME_SIDE}").alias("x"), "v"
    )
    lines = (
        pixels.join(cosines.withColumnRenamed("at", "x"), "x")
        .groupBy(*keys, "y")
        .agg(*[F.sum(F.col("v") * F.col(c)).alias(f"r{v}") for v, c in enumerate(waves)])
    )
    corners = (
        lines.join(cosines.withColumnRenamed("at", "y"), "y")
        .groupBy(*keys)
        .agg(F.array(*[F.sum(F.col(f"r{v}") * F.col(c)) for c in waves for v in range(CORNER)]).alias("coefs"))
    )
    ranked = F.array_sort(F.slice("coefs", 2, CORNER * CORNER - 1))
    middle = (F.get(ranked, F.lit(30)) + F.get(ranked, F.lit(31))) / 2
    bits = [F.when(F.col("coefs")[i] > F.col("middle"), F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i in range(64)]
    placed = [F.shiftleft(bit, 63 - i) for i, bit in enumerate(bits)]
    return corners.withColumn("middle", middle).select(*keys, reduce(lambda a, b: a.bitwiseOR(b), placed).alias("phash"))


def candidate_pairs(requests: DataFrame, cap: int | None = None) -> DataFrame:
    """Pairs of each request (base_id, candidates), numbered from 1: all of them, or the first `cap`."""
    listed = F.col("candidates") if cap is None else F.slice("candidates", 1, cap)
    return requests.select("base_id", F.posexplode(listed).alias("pos", "candidate_id")).select(
        "base_id", (F.col("pos") + 1).cast("bigint").alias("index"), "candidate_id"
    )


def _met_at_frames(met: DataFrame, other: DataFrame, pairs: DataFrame) -> DataFrame:
    heavy = heavy_keys(pairs, ["candidate_id"])
    if heavy.isEmpty():
        return met.join(other, ["candidate_id", "frame_idx"])
    return salted_join(met, other, ["candidate_id", "frame_idx"], ["base_id", "index"])


def phash_distances(requests: DataFrame, hashes: DataFrame, cap: int | None = None) -> DataFrame:
    """Distance statistics of every listed pair; null where a side has no frames.

    Pairs meet the frames of their base, and these the frames of the candidate at the same position, so a clip of any
    length is spread over its frames. A clip that very many requests name is salted.
    """
    # Laid out by clip once, with all three columns, so that each use reads the same shuffle and nothing is hashed twice.
    placed = hashes.filter("clip_id is not null and frame_idx is not null")
    known = placed.select("clip_id", "frame_idx", "phash").repartition("clip_id")
    pairs = candidate_pairs(requests, cap)
    pair = ["base_id", "index", "candidate_id"]
    base = known.withColumnsRenamed({"clip_id": "base_id", "phash": "base_hash"})
    other = known.withColumnsRenamed({"clip_id": "candidate_id", "phash": "other_hash"})
    met = salted_join(pairs, base, ["base_id"], ["index"])
    # Under a candidate's frame come at most as many rows as pairs name the candidate, so the pairs are counted, not the join.
    met = _met_at_frames(met, other, pairs)
    apart = F.expr("bit_count(base_hash ^ other_hash)")
    found = met.groupBy(*pair).agg(
        F.count(apart).alias("frames_compared"),
        F.sum(apart).cast("bigint").alias("total"),
        F.max(apart).cast("bigint").alias("max_distance"),
    )
    frames = known.groupBy("clip_id").agg(F.count_if(F.col("phash").isNotNull() & F.col("frame_idx").isNotNull()).alias("frames"))
    listed = salted_join(pairs, frames.withColumnsRenamed({"clip_id": "base_id", "frames": "base_frames"}), ["base_id"], ["index"], "left")
    listed = salted_join(
        listed,
        frames.withColumnsRenamed({"clip_id": "candidate_id", "frames": "other_frames"}),
        ["candidate_id"],
        ["base_id", "index"],
        "left",
        counted=pairs,
    )
    return listed.join(found, pair, "left").select(
        *pair,
        F.coalesce("base_frames", F.lit(0)).cast("bigint").alias("base_frames"),
        F.coalesce("other_frames", F.lit(0)).cast("bigint").alias("other_frames"),
        F.nullif("frames_compared", F.lit(0)).alias("frames_compared"),
        (F.col("total") / F.nullif("frames_compared", F.lit(0))).alias("mean_distance"),
        "max_distance",
    )


def compare_results(distances: DataFrame) -> DataFrame:
    """Result rows and error rows in one list: the rounded and the greatest distance and the verdict of a
    pair, or why it has none. A request whose base has no frames fails as a whole, that is, in every row.
    One pass over the pairs gives both kinds."""
    judged = distances.withColumn("verdict", match_verdict(F.col("mean_distance")))
    return judged.select(
        "base_id",
        "index",
        "candidate_id",
        "base_frames",
        "frames_compared",
        round_digits(F.col("mean_distance"), 2).alias("avg_distance"),
        "max_distance",
        "verdict",
        verdict_detail(F.col("verdict")).alias("detail"),
        F.when((F.col("base_frames") == 0) | (F.col("other_frames") == 0), NO_FRAMES)
        .when(F.col("frames_compared").isNull(), NOT_COMPARABLE)
        .alias("error"),
    )


def phash_compare(requests: DataFrame, hashes: DataFrame, cap: int | None = None) -> DataFrame:
    return compare_results(phash_distances(requests, hashes, cap))


# --- near duplicates ---


def _bands(band_bits: int) -> list[tuple[int, int]]:
    """First bit and number of bits of each band of a hash, as even as they come."""
    count = -(-HASH_BITS // band_bits)
    edges = [HASH_BITS * b // count for b in range(count + 1)]
    return list(zip(edges, (y - x for x, y in zip(edges, edges[1:]))))


def _flips(bits: int, most: int) -> list[tuple[int, int]]:
    """Masks of `bits` bits with at most `most` of them set, and how many are."""
    return [(sum(1 << bit for bit in chosen), n) for n in range(min(most, bits) + 1) for chosen in combinations(range(bits), n)]


def _radii(reach: int, bands: list) -> list[int]:
    """How many flips each band is tried with, -1 for not at all. If every band had one more, two hashes would be further apart than `reach`."""
    base, more = divmod(reach + 1 - len(bands), len(bands))
    return [base + (b < more) for b in range(len(bands))]


def meeting_rows(reach: int = MATCH_MAX, band_bits: int = BAND_BITS) -> int:
    """Rows that a frame sends, both sides together: what a band width costs."""

    def sent(width: int, radius: int) -> int:
        half = width // 2
        lower = sum(comb(half, used) * (radius - used + 1) for used in range(min(half, radius) + 1))
        return lower + sum(comb(width - half, n) for n in range(min(width - half, radius) + 1))

    bands = _bands(band_bits)
    return sum(sent(width, radius) for (_, width), radius in zip(bands, _radii(reach, bands)))


def meeting_share(reach: int = MATCH_MAX, band_bits: int = BAND_BITS) -> float:
    """The share of unrelated frame pairs that meet."""
    bands = _bands(band_bits)
    return sum(comb(width, n) / 2**width for (_, width), radius in zip(bands, _radii(reach, bands)) for n in range(radius + 1))


def _tried(bands: list[tuple[int, int]], reach: int) -> list[tuple[int, int, list, list]]:
    """For each band its first bit, its width, and the (mask, flips) that either side tries: one all flips of the
    upper half, the other all of the lower half for each number of flips that is left."""
    out = []
    for (first, width), radius in zip(bands, _radii(reach, bands)):
        half = width // 2
        upper = [(mask << half, n) for mask, n in _flips(width - half, radius)]
        lower = [(mask, n) for mask, used in _flips(half, radius) for n in range(radius - used + 1)]
        out.append((first, width, upper, lower))
    return out


def _signatures(hashes: DataFrame) -> DataFrame:
    """(clip_id, signature) of each clip with a hash."""
    hashed = F.when(F.col("phash").isNotNull(), F.struct("frame_idx", "phash"))
    return hashes.groupBy("clip_id").agg(F.array_sort(F.collect_list(hashed))["phash"].alias("signature")).filter(F.size("signature") > 0)


def _classes(signatures: DataFrame) -> DataFrame:
    """Each signature with its smallest clip and number of clips."""
    return signatures.groupBy("signature").agg(F.min("clip_id").alias("clip_id"), F.count("*").alias("copies"))


def _near(groups: DataFrame, threshold: int, band_bits: int, heavy_rows: int, common_rows: int) -> DataFrame:
    """(l, l_copies, r, r_copies, mean) for each two signatures within the threshold, each pair once."""
    pairs = _candidates(groups, threshold, band_bits, heavy_rows, common_rows)
    left = groups.select(F.col("clip_id").alias("l"), F.col("signature").alias("l_hashes"), F.col("copies").alias("l_copies"))
    right = groups.select(F.col("clip_id").alias("r"), F.col("signature").alias("r_hashes"), F.col("copies").alias("r_copies"))
    compared = "least(size(l_hashes), size(r_hashes))"
    total = f"aggregate(sequence(0, {compared} - 1), 0L, (sum, i) -> sum + bit_count(get(l_hashes, i) ^ get(r_hashes, i)))"
    return (
        pairs.join(left, "l")
        .join(right, "r")
        .select("l", "l_copies", "r", "r_copies", (F.expr(total) / F.expr(compared)).alias("mean"))
        .filter(F.col("mean") <= threshold)
    )


def _candidates(groups: DataFrame, threshold: int, band_bits: int, heavy_rows: int, common_rows: int) -> DataFrame:
    """(l, r): pairs of signatures that have two near frames at a position where the shorter one is looked up, each pair once."""
    bands = _bands(band_bits)
    frames = groups.select("clip_id", F.size("signature").alias("n"), F.posexplode("signature").alias("pos", "h"))
    common = heavy_keys(_values(frames, bands), VALUE, min(common_rows, heavy_rows))
    if common.isEmpty():
        probes = frames.withColumn("reach", F.lit(threshold))
        return _meet(probes, frames, threshold, bands, None).distinct()
    probes = _probes(frames, groups.count(), threshold, band_bits, common.filter(F.col("count") >= common_rows), heavy_rows)
    crowded = common.filter(F.col("count") >= heavy_rows)
    # From the threshold to its double.
    found = sorted(r[0] for r in probes.select("reach").distinct().collect())
    parts = []
    for reach in found:
        some = probes.filter(F.col("reach") == reach)
        parts.append(_meet(some, frames, reach, bands, crowded, heavy_keys(_values(some, bands), VALUE, heavy_rows), heavy_rows))
    return reduce(DataFrame.union, parts).distinct()


def _probes(frames: DataFrame, signatures: int, threshold: int, band_bits: int, common: DataFrame, heavy_rows: int) -> DataFrame:
    """The frames at which a signature is looked up, and how far its near frame can be (`reach`).

    The distances of a near pair of n frames add up to n times the threshold at most, and so do those at any k of the frames; one of these is within
    n / k times the threshold. A signature leaves out its commonest frames, up to half, as many as make it meet the fewest others by expectation: each
    one less means less of what shares it, but a further reach at the rest, at which more unrelated frames meet. A reach that
    would send many times the rows is not considered.
    """
    bands = _bands(band_bits)
    seen = salted_join(_values(frames, bands), common.withColumnRenamed("count", "holders"), VALUE, ["clip_id"], min_rows=heavy_rows)
    seen = seen.groupBy("clip_id", "n", "pos").agg(F.max("holders").alias("holders"))
    order = F.sort_array(F.collect_list(F.struct("holders", "pos")), asc=False)
    most = MORE_ROWS * meeting_rows(threshold, band_bits)
    met = [meeting_share(r, band_bits) if meeting_rows(r, band_bits) <= most else 1e9 for r in range(threshold, 2 * threshold + 1)]
    met_at = "array(" + ", ".join(f"{m!r}D" for m in met) + ")"
    expected = (
        f"get({met_at}, cast(floor({threshold} * n / (n - left_out)) as int) - {threshold}) * {signatures}D * (n - left_out)"
        " + aggregate(slice(order, left_out + 1, size(order)), 0D, (sum, f) -> sum + f.holders)"
    )
    choices = f"transform(sequence(0, least(size(order), n div 2)), left_out -> struct({expected} as met, left_out as left_out))"
    chosen = seen.groupBy("clip_id", "n").agg(order.alias("order")).selectExpr("clip_id", "order", f"array_min({choices}).left_out as left_out")
    chosen = chosen.selectExpr("clip_id", "slice(order, 1, left_out).pos as skipped")
    left = F.col("n") - F.when(F.col("skipped").isNull(), 0).otherwise(F.size("skipped"))
    return (
        frames.join(chosen, "clip_id", "left")
        .filter(F.col("skipped").isNull() | ~F.array_contains("skipped", F.col("pos")))
        .withColumn("reach", F.floor(F.lit(threshold) * F.col("n") / left).cast("int"))
        .drop("skipped")
    )


VALUE = ["pos", "band", "value"]


def _values(frames: DataFrame, bands: list[tuple[int, int]]) -> DataFrame:
    return frames.selectExpr("clip_id", "n", "pos", f"posexplode({_band_values(bands)}) as (band, value)")


def _band_values(bands: list[tuple[int, int]]) -> str:
    return "array(" + ", ".join(f"shiftrightunsigned(h, {first}) & {(1 << width) - 1}L" for first, width in bands) + ")"


def near_duplicate_members(hashes: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Each clip with its class, the smallest clip of equal hashes, and how many clips are in it. Classes are what
    `near_duplicates` and `near_duplicate_pairs` speak of. A signature that very many clips share is salted."""
    signatures = _signatures(hashes)
    named = _classes(signatures).withColumnRenamed("clip_id", "class_id")
    return salted_join(signatures, named, ["signature"], ["clip_id"], min_rows=heavy_rows).select("clip_id", "class_id", "copies")


def near_duplicate_pairs(
    hashes: DataFrame,
    threshold: int = MATCH_MAX,
    band_bits: int = BAND_BITS,
    heavy_rows: int = HEAVY_ROWS,
    common_rows: int = COMMON_ROWS,
) -> DataFrame:
    """All pairs of classes within the threshold, each once, with their mean distance."""
    near = _near(_classes(_signatures(hashes)), threshold, band_bits, heavy_rows, common_rows)
    return near.select(F.least("l", "r").alias("class_id"), F.greatest("l", "r").alias("other_id"), F.round("mean", 6).alias("mean_distance"))


def near_duplicates(
    hashes: DataFrame,
    threshold: int = MATCH_MAX,
    band_bits: int = BAND_BITS,
    heavy_rows: int = HEAVY_ROWS,
    common_rows: int = COMMON_ROWS,
) -> DataFrame:
    """Near copies of every signature: how many clips lie within a mean distance of `threshold`, and the nearest.

    One row per signature, named by its smallest clip; `near_duplicate_members` names all clips of each and
    `near_duplicate_pairs` all near partners.

    1. Clips with equal hashes become one signature with a number of copies (combined before the shuffle), so a group
       of copies of any size is one row from here on.
    2. A mean within the threshold needs one frame within it, and that frame one band within its share of it (shares add up to
       one less for each band but one, so some bands need fewer flips).
       Frames therefore meet on (position, band, value). One side tries all flips of the upper half of a value and the
       other side of the lower half, and the number of flips is a part of the key, so two frames whose bands are close
       enough meet there once, and others not at all. No near pair is missed, for any threshold and band width.
    3. Rows that meet carry one hash each, not a clip. Two frames that are not within the threshold themselves are
       dropped on the spot; that leaves nearly nothing but near frames. Their clips become pairs, once each, and only
       these are compared as a whole.
    4. A pair is looked for from its shorter signature (the smaller id of equals), all of whose frames are compared. Frames that
       `common_rows` signatures or more share (a black opening frame) are left out where that pays, and the others
       reach a little further. So a shared frame alone brings nobody together, and still no near pair is missed.
    5. Values that are still shared by very many signatures are salted over tasks.
    """
    groups = _classes(_signatures(hashes))
    once = _near(groups, threshold, band_bits, heavy_rows, common_rows)
    both = F.array(
        F.struct(F.col("l"), F.col("r"), F.col("r_copies"), "mean"),
        F.struct(F.col("r").alias("l"), F.col("l").alias("r"), F.col("l_copies").alias("r_copies"), "mean"),
    )
    near = (
        once.select(F.inline(both))
        .groupBy(F.col("l").alias("clip_id"))
        .agg(F.count("*").alias("near_signatures"), F.sum("r_copies").alias("near_clips"), F.min(F.struct("mean", "r")).alias("nearest"))
    )
    return (
        groups.select("clip_id", "copies")
        .join(near, "clip_id", "left")
        .select(
            "clip_id",
            "copies",
            F.coalesce("near_signatures", F.lit(0)).cast("bigint").alias("near_signatures"),
            F.coalesce("near_clips", F.lit(0)).cast("bigint").alias("near_clips"),
            F.col("nearest.r").alias("nearest_id"),
            F.round("nearest.mean", 6).alias("nearest_mean"),
        )
    )


def _meet(
    probes: DataFrame,
    frames: DataFrame,
    reach: int,
    bands: list[tuple[int, int]],
    crowded: DataFrame | None,
    crowded_probes: DataFrame | None = None,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Pairs (l, r) of `probes` (clip_id, n, pos, h) and `frames` (the same) whose hashes are within `reach` at one position, where l is the shorter clip or the smaller id of equals. A pair may come several times.

    Around crowded values, which are given with their counts, the side that has many rows under a key takes one salt by clip, and
    the rows of the other side are repeated for each salt. Both sides are many times the size that the
    planner expects of them, so the join is told to shuffle.
    """
    tried = _tried(bands, reach)

    def listed(side: int) -> str:
        """All (band, mask, flips) of one side, as an array."""
        return "array(" + ", ".join(f"struct({b} as band, {m}L as mask, {n} as flips)" for b, t in enumerate(tried) for m, n in t[side]) + ")"

    on = ["pos", "band", "key", "flips"]
    hot = None
    if crowded is not None:
        reached = [
            many.selectExpr("pos", "band", "value", "count", f"inline({listed(side)}) as (at_band, mask, flips)")
            .filter("band = at_band")
            .selectExpr("pos", "band", "value ^ mask as key", "flips", "count", f"'{name}' as many")
            for side, name, many in ((2, "l", crowded_probes), (3, "r", crowded))
        ]
        salts = F.ceil(F.max("count") / heavy_rows).cast("bigint").alias("salts")
        hot = reached[0].unionByName(reached[1]).groupBy(*on).agg(F.max_by("many", "count").alias("many"), salts)

    sides = []
    for side, name, rows in ((2, "l", probes), (3, "r", frames)):
        rows = rows.selectExpr("clip_id", "n", "pos", "h", f"{_band_values(bands)} as bands", f"inline({listed(side)})").selectExpr(
            f"clip_id as {name}", f"n as {name}_n", "pos", f"h as {name}_h", "band", "get(bands, band) ^ mask as key", "flips"
        )
        if hot is None:
            rows = rows.withColumn("salt", F.lit(0).cast("bigint"))
        else:
            one = F.array(F.pmod(F.xxhash64(name), F.col("salts")))
            every = F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)
            salt = F.when(F.col("many").isNull(), F.array(F.lit(0).cast("bigint"))).when(F.col("many") == name, one).otherwise(every)
            rows = rows.join(hot, on, "left").withColumn("salt", F.explode(salt)).drop("many", "salts")
        sides.append(rows.hint("merge"))
    met = sides[0].join(sides[1], [*on, "salt"])
    ahead = "(l_n < r_n or l_n = r_n and l < r)"
    return met.filter(f"{ahead} and bit_count(l_h ^ r_h) <= {reach}").select("l", "r")
