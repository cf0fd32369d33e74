"""Responses, metadata and message texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clipquarry.functions.semantics import BLANK, non_empty, or_default, trim_blanks, utc_wall_time, utf16_prefix

# Legal metadata keys, value length, response header and section patterns, text limits.
METADATA_KEYS = [
    "com.apple.quicktime.make",
    "com.apple.quicktime.model",
    "com.apple.quicktime.software",
    "com.apple.quicktime.creationdate",
    "com.apple.quicktime.location.ISO6709",
    "com.apple.quicktime.location.accuracy.horizontal",
    "make",
    "model",
    "creation_time",
]
METADATA_MAX = 256
CONTROL_CHARS = r"[\x00-\x1f\x7f]"
LANES = ["AUTHENTIC", "HIGH-END"]
LANE_LINE = rf"(?i)^LANE:{BLANK}*({'|'.join(LANES)}){BLANK}*\n+"
TALKING_LINE = rf"(?i)^TALKING:{BLANK}*(YES|NO){BLANK}*\n+"
ANALYSIS_LINE = rf"(?mi)^ANALYSIS{BLANK}*$"
PROMPT_LINE = rf"(?mi)^PROMPT{BLANK}+([A-Z]){BLANK}*(?:\|{BLANK}*(.*))?$"
PROMPT_MAX = 500
ERROR_MAX = 200
LOG_MAX = 60
DEFAULT_STATUS = 500


def clean_metadata_value(value: Column) -> Column:
    """Control characters out, trimmed, cut to length; null where nothing is left."""
    return non_empty(utf16_prefix(trim_blanks(F.regexp_replace(value, CONTROL_CHARS, "")), METADATA_MAX))


def allowed_metadata(pairs: Column) -> Column:
    """The legal keys of a MAP<STRING,STRING> that have a value left after cleaning."""
    legal = F.array(*[F.lit(k) for k in METADATA_KEYS])
    cleaned = F.transform_values(F.map_filter(pairs, lambda k, v: F.array_contains(legal, k)), lambda k, v: clean_metadata_value(v))
    return F.map_filter(cleaned, lambda k, v: v.isNotNull())


def parse_header(response: Column) -> dict[str, Column]:
    """Lane, talking flag and body of a model response. The lines are read at the start only, so an
    unknown lane line stays in the body and hides a talking line after it."""
    text = trim_blanks(F.coalesce(response, F.lit("")))
    lane = F.upper(non_empty(F.regexp_extract(text, LANE_LINE, 1)))
    rest = F.when(lane.isNotNull(), trim_blanks(F.regexp_replace(text, LANE_LINE, ""))).otherwise(text)
    talking = F.upper(non_empty(F.regexp_extract(rest, TALKING_LINE, 1)))
    body = F.when(talking.isNotNull(), trim_blanks(F.regexp_replace(rest, TALKING_LINE, ""))).otherwise(rest)
    return {
        "lane": F.coalesce(lane, F.lit(LANES[0])),
        "talking": F.coalesce(talking == "YES", F.lit(False)),
        "body": body,
        "error": F.when(text == "", "Empty response"),
    }


def section_source(response: Column) -> Column:
    """The part of a response after its first analysis line, or all of it."""
    text = trim_blanks(F.coalesce(response, F.lit("")))
    pieces = F.split(text, ANALYSIS_LINE, -1)
    return F.coalesce(non_empty(F.get(pieces, F.lit(1))), text)


def parse_sections(response: Column) -> Column:
    """STRUCT<analysis, prompts: ARRAY<STRUCT<id, label, text>>>; prompts without text are left out."""
    source = section_source(response)
    pieces = F.split(source, PROMPT_LINE, -1)
    ids = F.regexp_extract_all(source, F.lit(PROMPT_LINE), F.lit(1))
    labels = F.regexp_extract_all(source, F.lit(PROMPT_LINE), F.lit(2))
    prompts = F.transform(
        ids,
        lambda prompt_id, i: F.struct(
            prompt_id.alias("id"),
            trim_blanks(F.get(labels, i)).alias("label"),
            trim_blanks(F.get(pieces, i + 1)).alias("text"),
        ),
    )
    return F.struct(
        trim_blanks(F.get(pieces, F.lit(0))).alias("analysis"),
        F.filter(prompts, lambda p: p["text"] != "").alias("prompts"),
    )


def error_message(response_json: Column, own_message: Column) -> Column:
    """First non-empty message of a failed call: the nested one, the flat ones, the caller's own."""
    found = [non_empty(F.get_json_object(response_json, path)) for path in ("$.error.message", "$.message", "$.msg")]
    return F.coalesce(*found, own_message)


def error_status(status: Column) -> Column:
    return or_default(status, DEFAULT_STATUS).cast("bigint")


def truncated(text: Column, limit: int) -> Column:
    """The text cut to `limit` UTF-16 units."""
    return utf16_prefix(text, limit)


def iso_utc(ts: Column) -> Column:
    return F.date_format(utc_wall_time(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def artifact_key(kind: Column, created_at: Column, entry: Column) -> Column:
    """Registry key `<kind>_<epoch ms>_<6 characters>`, the same on every run."""
    tail = F.substring(F.sha2(entry.cast("string"), 256), 1, 6)
    return F.concat(kind, F.lit("_"), F.unix_millis(created_at).cast("string"), F.lit("_"), tail)


def data_url(payload: Column, media_type: str = "image/jpeg") -> Column:
    """Payload as one line of base64; `base64` itself breaks lines like mail does."""
    return F.concat(F.lit(f"data:{media_type};base64,"), F.translate(F.base64(payload), "\r\n", ""))
