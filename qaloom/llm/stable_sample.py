"""A reproducible sample that only grows when the data grow.

Identifiers are numbers of a fixed domain; a Feistel network permutes the
domain, and the identifiers whose permuted number lies under ``rate * size`` of
the domain are the sample.  A row's fate depends on its identifier alone: no
state, no order, no other rows, so every layout and rerun gives the same
sample, and what was selected stays selected when rows are added.

The domain is fixed once and for all: a prefix of up to ``LETTERS`` characters
of ``ALPHABET`` or none, and up to ``DIGITS`` digits.  Prefixes are read in base
39, digit strings are numbered by length and value, so that leading zeros count;
different identifiers have different numbers, however many digits they grow to.
The network works on the two parts as on mixed radix, so it is a permutation of
just this domain: no collisions.

Defined results: identifiers are compared without outer white space and letter
case, null and blank ones are no case, repeated ones count once.  An identifier
of another form (a longer prefix, more digits, other characters) has no number
of the domain; it is selected by a 60-bit hash against the same rate, stable but
not collision-free, and its origin says so: ``hashed``.  Extra columns are
ignored and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.functions.text import trimmed_lower

ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789_-"
LETTERS, DIGITS, ROUNDS = 11, 18, 6
BASE = len(ALPHABET) + 1
LEFT, RIGHT = BASE**LETTERS, (10 ** (DIGITS + 1) - 10) // 9
FORM = rf"^(?:([a-z0-9_-]{{1,{LETTERS}}})_)?([0-9]{{1,{DIGITS}}})$"
#: Numbers that the digit strings of a length begin after, for the lengths from 1.
BEFORE = tuple((10**n - 10) // 9 for n in range(1, DIGITS + 1))


def _hash(value: Column, key: str, size: int) -> Column:
    """Pseudo-random number below ``size`` of a value and a key: the first 60 bits of a digest."""
    digest = F.md5(F.concat(value.cast("string"), F.lit(f":{key}")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % F.lit(size)


def halves(identifier: Column) -> tuple[Column, Column]:
    """Numbers of an identifier's prefix and digits; null for other forms."""
    fits = identifier.rlike(FORM)
    prefix, digits = F.regexp_extract(identifier, FORM, 1), F.regexp_extract(identifier, FORM, 2)
    letters = F.filter(F.split(prefix, ""), lambda c: c != "")
    left = F.aggregate(letters, F.lit(0).cast("bigint"), lambda acc, c: acc * BASE + F.position(c, F.lit(ALPHABET)))
    before = F.element_at(F.array(*(F.lit(n).cast("bigint") for n in BEFORE)), F.length(digits))
    return F.when(fits, left), F.when(fits, digits.cast("bigint") + before)


def with_permuted(rows: DataFrame, identifier: str, seed: str) -> DataFrame:
    """Adds ``left`` and ``right``, the permuted identifier, one projection for each round."""
    left, right = halves(F.col(identifier))
    rows = rows.withColumn("left", left).withColumn("right", right)
    for r in range(ROUNDS):
        if r % 2 == 0:
            rows = rows.withColumn("left", (F.col("left") + _hash(F.col("right"), f"{seed}:{r}", LEFT)) % F.lit(LEFT))
        else:
            rows = rows.withColumn("right", (F.col("right") + _hash(F.col("left"), f"{seed}:{r}", RIGHT)) % F.lit(RIGHT))
    return rows


def stable_sample(rows: DataFrame, identifier: str, rate: float, seed: str = "1", keep: DataFrame | None = None, keep_identifier: str = "qid") -> DataFrame:
    """(identifier, origin): ``kept`` if an earlier selection holds it, else ``drawn`` or ``hashed``."""
    share = round(rate * 1_000_000)  # the rate in millionths, so that the bound is a whole number
    ids = rows.select(trimmed_lower(F.col(identifier)).alias("id")).where("id is not null").distinct()
    drawn = with_permuted(ids, "id", seed)
    bound = LEFT * share // 1_000_000  # permuted number = left * RIGHT + right
    other = _hash(F.col("id"), seed, 1_000_000) < share
    selected = F.when(F.col("left").isNull(), other).otherwise(F.col("left") < bound)
    drawn = drawn.select("id", selected.alias("drawn"), F.when(F.col("left").isNull(), "hashed").otherwise("drawn").alias("how"))
    if keep is None:
        return drawn.where("drawn").select(F.col("id").alias(identifier), F.col("how").alias("origin"))
    kept = keep.select(trimmed_lower(F.col(keep_identifier)).alias("id")).where("id is not null").distinct().withColumn("kept", F.lit(True))
    both = drawn.join(kept, "id", "left").where("drawn or kept")
    return both.select(F.col("id").alias(identifier), F.when(F.col("kept"), F.lit("kept")).otherwise(F.col("how")).alias("origin"))
