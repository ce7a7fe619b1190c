"""Text expressions shared by all operators (JVM side, no Python workers)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Maximal runs of letters and digits; texts are lower-cased first.
WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Words of a text; no words for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1)), F.array().cast("array<string>"))


def word_text(text: Column) -> Column:
    """Words joined by one blank: equal exactly if the words are the same in the same order."""
    return F.array_join(words(text), " ")


def vkey(video: Column) -> Column:
    """Video key: lower case, outer white space removed, inner runs made one blank; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_replace(video, r"^\s+|\s+$", "")), r"\s+", " "), F.lit(""))


def label(text: Column) -> Column:
    """Category key: lower case, trimmed, runs of blanks, ``_`` and ``-`` made one ``_``; null if nothing is left."""
    trimmed = F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))
    return F.nullif(F.regexp_replace(trimmed, r"[\s_-]+", "_"), F.lit(""))


def trimmed_lower(text: Column) -> Column:
    """Outer white space and letter case removed; null if nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(text, r"^\s+|\s+$", "")), F.lit(""))


def blank(text: Column) -> Column:
    """Whether a text is null or all white space."""
    return ~F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def folded(text: Column) -> Column:
    """Lower case with sharp s written out, which is case folding for western text."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def question_key(text: Column) -> Column:
    """Question for template matching: trimmed, white space collapsed, case folded; '' for null."""
    return F.coalesce(folded(F.trim(F.regexp_replace(text, r"(?U)\s+", " "))), F.lit(""))


def intent_text(text: Column) -> Column:
    """Question for intent cues: spelling variants of a few words unified, clock times replaced by ``<time>``."""
    t = F.regexp_replace(folded(text), "[\u2013\u2014]", "-")
    t = F.regexp_replace(t, r"\btime[\s-]*point\b", "time point")
    t = F.regexp_replace(t, r"\bre[\s-]*appear\b", "reappear")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.regexp_replace(t, r"\b\d{2}:\d{2}:\d{2}\b", "<time>")


def token(text: Column) -> Column:
    """Lower-case letters and digits, everything between them one ``_``."""
    return F.btrim(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), F.lit("_"))


def slug(text: Column, longest: int = 60) -> Column:
    """File-name-safe form; ``video`` if nothing is left."""
    t = F.btrim(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), F.lit("._-"))
    return F.substring(F.coalesce(F.nullif(t, F.lit("")), F.lit("video")), 1, longest)


def stem(name: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def cache_folder(dataset: Column, video: Column) -> Column:
    """Stable folder of a video's cached frames: slug and the first 12 digits of a digest of dataset and video."""
    digest = F.substring(F.sha1(F.concat_ws("|", dataset, video)), 1, 12)
    return F.concat_ws("_", slug(stem(video)), digest)


def as_double(text: Column) -> Column:
    """Number of a text cell; null if blank, not a number or NaN."""
    n = F.nullif(F.trim(text), F.lit("")).try_cast("double")
    return F.when(~F.isnan(n), n)


def as_whole(text: Column) -> Column:
    """Whole part of a text cell's number, toward zero."""
    return F.when(as_double(text).isNotNull(), F.when(as_double(text) >= 0, F.floor(as_double(text))).otherwise(F.ceil(as_double(text))).cast("bigint"))


def listing(names: Column) -> Column:
    """``a``, ``a and b`` or ``a, b, and c``; null for an empty list."""
    n = F.size(names)
    long = F.concat(F.array_join(F.slice(names, F.lit(1), n - 1), ", "), F.lit(", and "), F.element_at(names, -1))
    return F.when(n == 1, F.get(names, 0)).when(n == 2, F.array_join(names, " and ")).when(n > 2, long)


def alternation(words: list[str]) -> str:
    """Pattern of any of the words, the longest first, so that no word hides a longer one that begins with it."""
    return "|".join(re.escape(w).replace("\\ ", " ") for w in sorted(set(words), key=lambda w: (-len(w), w)))


def file_for(folder: str, key: Column, suffix: str) -> Column:
    """``folder/key.suffix``; null for a null key."""
    return F.concat(F.lit(folder.rstrip("/") + "/"), key, F.lit("." + suffix.lstrip(".")))


def utc_now() -> Column:
    """Time of the query in UTC, as ISO text; for audit records, not for results."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
