"""Which fetcher a source goes to, and whether what came back is usable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clipquarry.functions.semantics import non_empty

# Source patterns, size limits in bytes, fetch error patterns and messages.
POST_PATTERN = r"instagram\.com/(p|reel|reels)/"
CLIP_PATTERN = r"tiktok\.com/@[^/]+/video/|tiktok\.com/t/"
MEDIA_MIN = 1000
AUDIO_SILENT_MAX = 1000
AUDIO_MIN = 2000
ANALYSIS_MAX = {"instagram": 200 * 1024 * 1024, "direct": 200 * 1024 * 1024}
AUDIO_MAX = {"instagram": 200 * 1024 * 1024, "direct": 300 * 1024 * 1024}
TIMING_MAX = 60 * 1024 * 1024
GONE_PATTERN = r"not_?found|no results|does not exist|deleted|removed|no longer available|404"
RESTRICTED_PATTERN = r"restrict|private|login|unavailable|age|gated|geoblock|forbidden|403|sign in"
FETCH_MESSAGES = {
    "not_found": "This Instagram post no longer exists — it was deleted or the link is wrong.",
    "restricted_page": "This account is private or restricted, so the post cannot be fetched.",
    "unknown": "Could not find this Instagram post — it may be private, deleted, or the link is invalid.",
}


def platform(url: Column) -> Column:
    """Where a source lives; null for a missing url. Matching is unanchored and case-sensitive."""
    return (
        F.when(url.isNull() | (url == ""), F.lit(None).cast("string"))
        .when(url.rlike(POST_PATTERN), "instagram")
        .when(url.rlike(CLIP_PATTERN), "tiktok")
        .otherwise("direct")
    )


def fetcher(source_platform: Column) -> Column:
    """Fetcher of the analysis and audio entries."""
    return (
        F.when(source_platform == "instagram", "scraper")
        .when(source_platform == "tiktok", "downloader")
        .when(source_platform == "direct", "http")
    )


def hosting_fetcher(source_platform: Column) -> Column:
    """Fetcher of the hosting entry, which hands every other source to the downloader."""
    return F.when(source_platform == "instagram", "scraper").when(source_platform.isNotNull(), "downloader")


def is_html(content_type: Column, head: Column) -> Column:
    typed = F.coalesce(content_type.contains("text/html"), F.lit(False))
    opened = F.coalesce(head.startswith("<!") | head.startswith("<h"), F.lit(False))
    return typed | opened


def _over(size: Column, source_platform: Column, limits: dict[str, int]) -> Column:
    """Whether a payload is larger than its fetcher takes; a platform without a limit takes any size."""
    most = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    return F.coalesce(size > F.try_element_at(most, source_platform), F.lit(False))


def analysis_reject_reason(source_platform: Column, content_type: Column, head: Column, size: Column) -> Column:
    """Why a fetched payload is refused for analysis: only direct sources are checked for HTML, only
    the others for being too small."""
    direct = source_platform == "direct"
    return (
        F.when(_over(size, source_platform, ANALYSIS_MAX), "too_large")
        .when(direct & is_html(content_type, head), "html_page")
        .when(~direct & (size < MEDIA_MIN), "too_small")
    )


def audio_reject_reason(source_platform: Column, size: Column) -> Column:
    """Why a fetched payload is refused for audio extraction."""
    return F.when(_over(size, source_platform, AUDIO_MAX), "too_large").when(size < MEDIA_MIN, "too_small")


def speech_track_state(size: Column) -> Column:
    """Whether the audio of an analysed clip is worth transcribing."""
    return F.when(size <= AUDIO_SILENT_MAX, "silent").otherwise("usable")


def extracted_track_state(size: Column) -> Column:
    """Whether an extracted audio file holds anything."""
    return F.when(size < AUDIO_MIN, "no_audio").otherwise("usable")


def timing_track_state(size: Column) -> Column:
    """Whether an audio file is small enough for word timings."""
    return F.when(size > TIMING_MAX, "too_large").otherwise("usable")


def fetch_error_reason(error: Column, description: Column) -> Column:
    """Class of a scraper error; a gone post is recognised before a restricted one."""
    raw = F.lower(F.coalesce(non_empty(error), non_empty(description), F.lit("")))
    return (
        F.when(raw.rlike(GONE_PATTERN), "not_found").when(raw.rlike(RESTRICTED_PATTERN), "restricted_page").otherwise("unknown")
    )


def fetch_error_message(reason: Column) -> Column:
    texts = F.create_map(*[F.lit(x) for pair in FETCH_MESSAGES.items() for x in pair])
    return texts[reason]
