"""Room profiles of a recording."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipquarry.functions.semantics import to_number

# Profile -> (ambience bed, level in dB, phone microphone).
ROOM_PROFILES = {
    "studio": (None, None, False),
    "room": ("anoisesrc=color=brown:amplitude=0.9,lowpass=f=250", -34.0, True),
    "car": ("anoisesrc=color=brown:amplitude=0.9,lowpass=f=320", -26.0, True),
    "street": ("anoisesrc=color=pink:amplitude=0.9,lowpass=f=1500,highpass=f=120", -25.0, True),
    "cafe": ("anoisesrc=color=pink:amplitude=0.9,highpass=f=300,lowpass=f=2500", -28.0, True),
    "gym": ("anoisesrc=color=brown:amplitude=0.9,lowpass=f=500", -27.0, True),
    "office": ("anoisesrc=color=brown:amplitude=0.9,lowpass=f=400", -32.0, True),
}
DEFAULT_PROFILE = "room"


def profile_table(spark: SparkSession) -> DataFrame:
    rows = [(name, *values) for name, values in ROOM_PROFILES.items()]
    return spark.createDataFrame(rows, "profile string, bed string, bed_db double, phone boolean")


def profile_lookup(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profile and bed level of each request (profile, has_level, level_raw).

    An unknown name falls back to the default. A level that is sent replaces the profile's where it
    spells a number: null spells 0, an absent level or other text leaves the profile's own.
    """
    found = requests.join(F.broadcast(profiles.withColumn("_known", F.lit(True))), "profile", "left")
    bed, bed_db, phone = ROOM_PROFILES[DEFAULT_PROFILE]
    known = F.coalesce("_known", F.lit(False))
    filled = found.withColumns(
        {
            "profile": F.when(known, F.col("profile")).otherwise(F.lit(DEFAULT_PROFILE)),
            "bed": F.when(known, F.col("bed")).otherwise(F.lit(bed)),
            "bed_db": F.when(known, F.col("bed_db")).otherwise(F.lit(bed_db)),
            "phone": F.when(known, F.col("phone")).otherwise(F.lit(phone)),
        }
    )
    sent = F.when(F.col("has_level"), to_number(F.col("level_raw")))
    level = F.when(F.col("bed").isNotNull(), F.coalesce(sent, F.col("bed_db")))
    return filled.withColumn("level_db", level).drop("_known", "bed_db", "has_level", "level_raw")
