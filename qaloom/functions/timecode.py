"""Seconds and ``HH:MM:SS`` clock times as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLOCK = r"\d{2}:\d{2}:\d{2}"
STRICT_CLOCK = r"\d{2}:[0-5]\d:[0-5]\d"


def hhmmss(seconds: Column) -> Column:
    """Clock text of whole seconds, hours not wrapped; null for null, NaN and negative values."""
    s = F.floor(seconds).cast("bigint")
    text = F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("bigint"), F.floor(s % 3600 / 60).cast("bigint"), s % 60)
    return F.when(seconds.isNotNull() & ~F.isnan(seconds.cast("double")) & (seconds >= 0), text)


def _parts(text: Column) -> Column:
    p = F.split(text, ":")
    return F.get(p, 0).try_cast("bigint") * 3600 + F.get(p, 1).try_cast("bigint") * 60 + F.get(p, 2).try_cast("bigint")


def strict_seconds(text: Column) -> Column:
    """Seconds of exactly two digits each, minutes and seconds below 60; else null."""
    return F.when(text.rlike(rf"\A{STRICT_CLOCK}\z"), _parts(text).cast("double"))


def lenient_seconds(text: Column) -> Column:
    """Seconds of any three numbers parted by colons with minutes and seconds below 60; else null."""
    p = F.split(text, ":")
    sound = (F.size(p) == 3) & F.get(p, 1).try_cast("int").between(0, 59) & F.get(p, 2).try_cast("int").between(0, 59)
    return F.when(sound, _parts(text).cast("double"))


def clock_times(text: Column) -> Column:
    """All clock times of a text, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"\b{CLOCK}\b"), F.lit(0)))


def rint_index(seconds: Column, fps: Column, total_frames: Column) -> Column:
    """Frame nearest to a time, ties to the even frame, within the video."""
    return F.greatest(F.lit(0).cast("bigint"), F.least(total_frames.cast("bigint") - 1, F.rint(seconds * fps).cast("bigint")))
