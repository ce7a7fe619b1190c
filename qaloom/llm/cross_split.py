"""Same or nearly same records across splits.

An edit-distance segment join.  Each evaluation text (a sequence of words) is
cut into segments; if a training text lies within ``k`` edits, at least one of
any ``k + 1`` disjoint segments occurs in it unchanged, at most ``k`` positions
off.  Training texts therefore offer all their substrings of the segment length,
equal pairs of (answer, segment) meet, the position is checked, and a banded
dynamic programme verifies each surviving pair.

Which ``k + 1`` segments are cut is free as long as they are disjoint, so a
dynamic programme takes those that are rarest in training: hot phrases are
avoided, and no pair is lost.  Rarity is read from a table of ``COUNTERS``
counters over all training substrings, filled in the tasks.  Substrings that no
evaluation text has cut can't meet anything; most are dropped where they arise
by a bitmap of at most ``MOST_BITS`` bits of the segments cut.  Where there are
more segments than it can hold it lets more through, and the join decides.

Texts that are equal on one side form one class; only classes are compared.
A class is one row of the written texts, found by a 128-bit digest of answer and
text, and texts are exchanged only to be compared.

Defined results: rows without id or split, and splits other than the given
ones, make no case; a null text has no words and equals another without words;
repeated rows count once; extra columns are ignored; an empty side gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaloom.functions.text import trimmed_lower, word_text
from qaloom.llm.bitmaps import bitmap, marked_in
from qaloom.operators.lineage import cut

SEGMENT = 5  # words; shorter for short texts, see segment_length
STRETCH = 1000  # words that segments are chosen in together
COUNTERS = 1 << 18
PIECE = 1 << 12  # counters in a row that is exchanged or goes to the driver
MOST_BITS = 1 << 27


def edits_allowed(n: int, m: int, per: int = 10) -> int:
    """A tenth of the words of the longer text."""
    return max(n, m) // per


@lru_cache(100_000)
def most_edits(n: int, per: int = 10) -> int:
    """The most edits that any partner of a text of ``n`` words may be away."""
    m = n
    while m + 1 - (m + 1) // per <= n:
        m += 1
    return m // per


def segment_length(n: int, per: int = 10, segment: int = SEGMENT) -> int:
    """Words in a segment, so that ``most_edits + 1`` disjoint ones fit; 0 if only equal texts can match."""
    k = most_edits(n, per)
    return min(segment, n // (k + 1)) if k else 0


@lru_cache(100_000)
def partner_segment_lengths(n: int, per: int = 10, segment: int = SEGMENT) -> tuple[int, ...]:
    """Segment lengths of all evaluation texts that a training text of ``n`` words may match."""
    lengths = range(n - n // per, n + most_edits(n, per) + 1)
    return tuple(sorted({segment_length(x, per, segment) for x in lengths} - {0}))


class _Words(dict):
    """Word to 64-bit number, filled as words are met; emptied when it grows large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def numbers(self, text: str) -> np.ndarray:
        return np.array([self[w] for w in text.split(" ")] if text else [], dtype=np.uint64)


_FACTOR, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


def gram_hashes(numbers: np.ndarray, size: int, salt: int) -> np.ndarray:
    """Hashes of all substrings of ``size`` words, together with the answer's hash and the size."""
    n = len(numbers) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    out = np.full(n, np.uint64((salt + size) & 0xFFFFFFFFFFFFFFFF))
    for j in range(size):
        out = (out ^ numbers[j : j + n]) * _FACTOR
        out ^= out >> _SHIFT
    return out.view(np.int64)


def rarest_segments(costs: np.ndarray, size: int, number: int) -> np.ndarray:
    """Mask of ``number`` disjoint windows of ``size`` with the least total cost, in each row of ``costs``.

    Dynamic programming from the end, all rows at once.  Rows longer than
    ``STRETCH`` are cut into stretches with their share of the windows each: the
    windows stay disjoint and as many, only their choice is made stretch by stretch.
    """
    rows, n = costs.shape
    if n > 2 * STRETCH:
        mask = np.zeros(costs.shape, dtype=bool)
        bounds = np.linspace(0, n + size - 1, (n + size - 1) // STRETCH + 1).astype(int)
        shares = bounds * number // (n + size - 1)
        for i, j, k in zip(bounds, bounds[1:], np.diff(shares)):
            mask[:, i : j - size + 1] = rarest_segments(costs[:, i : j - size + 1], size, int(k))
        return mask
    far = np.iinfo(np.int64).max // 4
    best = np.full((n + size + 1, rows, number + 1), far, dtype=np.int64)
    best[:, :, 0] = 0
    take = np.zeros((n, rows, number + 1), dtype=bool)
    for i in range(n - 1, -1, -1):
        with_it = best[i + size, :, :-1] + costs[:, i, None]
        np.less(with_it, best[i + 1, :, 1:], out=take[i, :, 1:])
        np.minimum(with_it, best[i + 1, :, 1:], out=best[i, :, 1:])
    mask = np.zeros((rows, n), dtype=bool)
    free, left, row = np.zeros(rows, dtype=np.int64), np.full(rows, number), np.arange(rows)
    for i in range(n):
        now = (free <= i) & take[i, row, left]
        mask[now, i] = True
        free[now] = i + size
        left[now] -= 1
    return mask


def within_edits(left: list[np.ndarray], right: list[np.ndarray], limit: np.ndarray) -> np.ndarray:
    """Edit distance of each pair if at most its limit, else -1: banded dynamic programming, all pairs of a batch at once."""
    size = len(left)
    n, m = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    out = np.full(size, -1, dtype=np.int64)
    live = np.flatnonzero(np.abs(n - m) <= limit)
    if not len(live):
        return out
    band = int(limit[live].max())
    rows, width, far = int(n[live].max()), 2 * band + 1, np.int32(1 << 28)
    # column c of row i is the cell (i, i + c - band)
    padded = np.zeros((len(live), int(max(m[live].max(), rows)) + 2 * band + 2), dtype=np.uint64)
    a = np.zeros((len(live), rows), dtype=np.uint64)
    for k, p in enumerate(live):
        a[k, : n[p]] = left[p]
        padded[k, band : band + m[p]] = right[p]
    steps = np.arange(width, dtype=np.int32)
    column = steps[None, :] - band
    lengths = m[live][:, None]
    row = np.where((column >= 0) & (column <= lengths), column, far).astype(np.int32)
    result = np.where(n[live] == 0, m[live], far).astype(np.int64)
    for i in range(1, rows + 1):
        j = column + i
        inside = (j >= 0) & (j <= lengths)
        swap = row + (a[:, i - 1 : i] != padded[:, i - 1 : i - 1 + width])
        swap = np.where(j >= 1, swap, far)
        drop = np.concatenate((row[:, 1:], np.full((len(live), 1), far, np.int32)), axis=1) + 1
        row = np.where(inside, np.minimum(swap, drop), far).astype(np.int32)
        row = np.minimum.accumulate(row - steps, axis=1) + steps  # insertions run along the row
        row = np.where(inside, np.minimum(row, far), far).astype(np.int32)
        ended = n[live] == i
        if ended.any():
            c = (m[live] - i + band)[ended]
            result[ended] = row[np.flatnonzero(ended), c]
    out[live] = np.where(result <= limit[live], result, -1)
    return out


def texts(records: DataFrame, record_id: str, split: str, text: str, answer: str, train: str, evaluation: tuple[str, ...]) -> DataFrame:
    """(row, id, split, side, class_key, answer_key, words), written once: sides are 0 for training and 1 for evaluation."""
    rows = records.select(F.col(record_id).alias("id"), trimmed_lower(F.col(split)).alias("split"), word_text(F.col(text)).alias("words"), word_text(F.col(answer)).alias("answer"))
    rows = rows.where(F.col("id").isNotNull() & F.col("split").isin(train, *evaluation))
    side = F.when(F.col("split") == train, 0).otherwise(1)
    class_key = F.unhex(F.md5(F.concat_ws("|", "answer", "words")))  # words hold no mark
    return cut(rows.select(F.monotonically_increasing_id().alias("row"), "id", "split", side.alias("side"), class_key.alias("class_key"), F.unhex(F.md5("answer")).alias("answer_key"), "words"))


def classes(rows: DataFrame) -> DataFrame:
    """(class, side, class_key, answer_key, words), written: one row for each text of a side whose answer both sides have."""
    each = rows.groupBy("side", "class_key").agg(F.min("row").alias("class"), F.min("answer_key").alias("answer_key"))
    both = each.groupBy("answer_key").agg(F.min("side").alias("a"), F.max("side").alias("b")).where("a <> b").select("answer_key")
    live = cut(each.join(both, "answer_key", "left_semi").select("class"))
    return cut(rows.join(live, F.col("row") == F.col("class")).select("class", "side", "class_key", "answer_key", "words"))


def _salt(answer_key: bytes) -> int:
    return int.from_bytes(answer_key[:8], "big")


def _offers(batch: pd.DataFrame, numbers: _Words, per: int):
    """(class, words, hashes of the substrings) of training texts, once for each segment length in question."""
    for c, answer, words in zip(batch["class"], batch["answer_key"], batch["words"]):
        x = numbers.numbers(words)
        for size in partner_segment_lengths(len(x), per):
            h = gram_hashes(x, size, _salt(answer))
            if len(h):
                yield c, len(x), h


def substring_counts(train: DataFrame, per: int) -> np.ndarray:
    """Occurrences of all training substrings in ``COUNTERS`` counters by hash."""

    def work(batches):
        numbers, total = _Words(), np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            found = [h for _, _, h in _offers(batch, numbers, per)]
            if found:
                total += np.bincount(np.concatenate(found) & (COUNTERS - 1), minlength=COUNTERS)
        for i in range(0, COUNTERS, PIECE):
            if total[i : i + PIECE].any():
                yield pd.DataFrame({"at": [i], "n": [total[i : i + PIECE].tobytes()]})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, n in zip(batch["at"].tolist(), batch["n"]):
                part = np.frombuffer(n, dtype=np.int64)
                sums[i] = sums[i] + part if i in sums else part
        for i, n in sums.items():
            yield pd.DataFrame({"at": [i], "n": [n.tobytes()]})

    parts = train.select("class", "answer_key", "words").mapInPandas(work, "at long, n binary").repartition("at")
    out = np.zeros(COUNTERS, dtype=np.int64)
    for row in parts.mapInPandas(add, "at long, n binary").collect():  # 8 bytes a counter, packed
        part = np.frombuffer(row["n"], dtype=np.int64)
        out[row["at"] : row["at"] + len(part)] += part
    return out


def cut_segments(held: DataFrame, counts: np.ndarray, per: int) -> DataFrame:
    """(gram, class, at, n): the rarest disjoint segments of each evaluation class, without those that training lacks for sure."""
    counters = held.sparkSession.sparkContext.broadcast(counts)

    def work(batches):
        numbers = _Words()
        for batch in batches:
            by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
            for c, answer, words in zip(batch["class"], batch["answer_key"], batch["words"]):
                x = numbers.numbers(words)
                if size := segment_length(len(x), per):
                    by_length.setdefault(len(x), []).append((c, gram_hashes(x, size, _salt(answer))))
            for n, same in by_length.items():  # texts of one length are worked on together
                size, number = segment_length(n, per), most_edits(n, per) + 1
                step = max(1, 2_000_000 // (n * (number + 1)))
                for i in range(0, len(same), step):
                    grams = np.stack([g for _, g in same[i : i + step]])
                    costs = counters.value[grams & (COUNTERS - 1)]
                    row, at = np.nonzero(rarest_segments(costs, size, number) & (costs > 0))
                    yield pd.DataFrame({"gram": grams[row, at], "class": np.array([c for c, _ in same[i : i + step]])[row], "at": at.astype(np.int32), "n": np.full(len(at), n, dtype=np.int32)})

    return held.select("class", "answer_key", "words").mapInPandas(work, "gram long, class long, at int, n int")


def offered(train: DataFrame, marked: np.ndarray, per: int) -> DataFrame:
    """(gram, class, at, n): substrings of training texts that the bitmap lets through."""
    bits = train.sparkSession.sparkContext.broadcast(marked)

    def work(batches):
        numbers, words = _Words(), bits.value
        for batch in batches:
            parts = list(_offers(batch, numbers, per))
            for i in range(0, len(parts), 2000):
                some = parts[i : i + 2000]
                sizes = [len(h) for _, _, h in some]
                gram = np.concatenate([h for _, _, h in some])
                keep = marked_in(words, gram)
                at = np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])
                yield pd.DataFrame({"gram": gram[keep], "class": np.repeat([c for c, _, _ in some], sizes)[keep], "at": at[keep], "n": np.repeat(np.array([n for _, n, _ in some], dtype=np.int32), sizes)[keep]})

    return train.select("class", "answer_key", "words").mapInPandas(work, "gram long, class long, at int, n int")


def near_pairs(classes_: DataFrame, per: int = 10) -> DataFrame:
    """(class_train, class_eval, edits): pairs of classes with the same answer whose texts are within a tenth of edits."""
    train, held = classes_.where("side = 0"), classes_.where("side = 1")
    equal = train.select(F.col("class").alias("class_train"), "class_key").join(held.select(F.col("class").alias("class_eval"), "class_key"), "class_key").select("class_train", "class_eval", F.lit(0).cast("bigint").alias("edits"))
    segments = cut(cut_segments(held, substring_counts(train, per), per))
    a, b = offered(train, bitmap(segments, "gram", MOST_BITS), per).alias("a"), segments.alias("b")
    limit = F.floor(F.greatest("a.n", "b.n") / per)
    met = a.join(b, F.col("a.gram") == F.col("b.gram")).where((F.abs(F.col("a.at") - F.col("b.at")) <= limit) & (F.abs(F.col("a.n") - F.col("b.n")) <= limit))
    pairs = cut(met.select(F.col("a.class").alias("class_train"), F.col("b.class").alias("class_eval")).distinct())
    of = lambda s, x: s.select(F.col("class").alias(f"class_{x}"), F.col("class_key").alias(f"key_{x}"), F.col("answer_key").alias(f"answer_{x}"), F.col("words").alias(f"words_{x}"))
    whole = pairs.join(of(train, "train"), "class_train").join(of(held, "eval"), "class_eval").where("answer_train = answer_eval and key_train <> key_eval")

    def verify(batches):
        numbers = _Words()
        for batch in batches:
            if not len(batch):
                continue
            left = [numbers.numbers(t) for t in batch["words_train"]]
            right = [numbers.numbers(t) for t in batch["words_eval"]]
            edits = np.full(len(batch), -1, dtype=np.int64)
            order = np.argsort([max(len(x), len(y)) for x, y in zip(left, right)], kind="stable")
            at = 0
            while at < len(order):  # texts of like length together, so that the band fits
                longest = max(len(left[order[at]]), len(right[order[at]]), 1)
                some = order[at : at + max(1, min(1000, 4_000_000 // (longest * 2)))]
                l, r = [left[i] for i in some], [right[i] for i in some]
                edits[some] = within_edits(l, r, np.array([edits_allowed(len(x), len(y), per) for x, y in zip(l, r)]))
                at += len(some)
            keep = edits >= 0
            yield pd.DataFrame({"class_train": batch["class_train"][keep], "class_eval": batch["class_eval"][keep], "edits": edits[keep]})

    checked = whole.select("class_train", "class_eval", "words_train", "words_eval").mapInPandas(verify, "class_train long, class_eval long, edits long")
    return equal.unionByName(checked)


def linked_classes(records: DataFrame, record_id: str = "sample_id", split: str = "split", text: str = "user_text", answer: str = "assistant_text", train: str = "train", evaluation: tuple[str, ...] = ("val", "test"), per: int = 10) -> tuple[DataFrame, DataFrame]:
    """Links (class_train, class_eval, edits) of classes that match, and members (id, split, side, class) of these classes.

    This is the whole result without copies multiplied out.
    """
    rows = texts(records, record_id, split, text, answer, train, evaluation)
    sides = classes(rows)
    links = cut(near_pairs(sides, per))
    linked = links.select(F.col("class_train").alias("class")).union(links.select("class_eval")).distinct()
    named = sides.join(linked, "class", "left_semi").select("side", "class_key", "class")
    members = rows.select("id", "split", "side", "class_key").distinct().join(named, ["side", "class_key"]).select("id", "split", "side", "class")
    return links, members


def cross_split_overlaps(records: DataFrame, record_id: str = "sample_id", split: str = "split", text: str = "user_text", answer: str = "assistant_text", train: str = "train", evaluation: tuple[str, ...] = ("val", "test"), per: int = 10) -> DataFrame:
    """(train_id, eval_id, eval_split, edits): all pairs of records, one of training and one of an evaluation split."""
    links, members = linked_classes(records, record_id, split, text, answer, train, evaluation, per)
    members = cut(members)
    a = members.where("side = 0").select(F.col("id").alias("train_id"), F.col("class").alias("class_train"))
    b = members.where("side = 1").select(F.col("id").alias("eval_id"), F.col("split").alias("eval_split"), F.col("class").alias("class_eval"))
    pairs = links.join(a, "class_train").join(b, "class_eval")
    return pairs.where("train_id <> eval_id").groupBy("train_id", "eval_id", "eval_split").agg(F.min("edits").alias("edits"))
