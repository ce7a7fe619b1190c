"""Find text that was decoded with the wrong character encoding and restore it.

Three steps, all over the whole corpus and whole texts:

1. count adjacent character pairs and turn each pair into the information it
   contributes to the corpus (``p(xy) * log2(p(xy) / p(x)p(y))``, in bits of
   log scale, for a corpus of ``REFERENCE`` pairs where there are more).  Characters fall into ``N_CLASSES`` classes, so the table has at
   most ``N_CLASSES ** 2`` cells whatever the size of the corpus; that is the
   bound under which it is sent to the executors.  Copies of a text count once,
   else a garbled text that is repeated often makes its own pairs probable.
2. isolate improbable runs in each text: maximum-scoring segments of
   ``threshold - information(pair)``.  The threshold is a quantile of the
   corpus itself.
3. inside those runs only, try the inverse mappings (bytes of one encoding read
   as another, also twice) and keep one whose outcome carries clearly more
   information than the run had.

Defined results: null, empty and pure ASCII texts are never affected; a text
holding U+FFFD is affected and its loss is reported (``lost``), the rest of it
is still restored where a mapping fits.  Repeated rows with the same id and text
count once.  Extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- classes of characters -------------------------------------------------

_OWN = [(0x00, 0x180), (0x370, 0x400), (0x400, 0x460), (0x2000, 0x2070), (0x2100, 0x2150), (0x2200, 0x2300), (0x2500, 0x25A0), (0xFFFD, 0xFFFE)]
_OWN_SIZE = sum(b - a for a, b in _OWN)
EDGE = _OWN_SIZE + 0x110 + 1
N_CLASSES = EDGE + 1


@lru_cache(1)
def class_table() -> np.ndarray:
    """Class of every code point: frequent blocks keep single characters, the rest share one class per 4096."""
    table = (_OWN_SIZE + (np.arange(0x110000) >> 12)).astype(np.uint16)
    at = 0
    for a, b in _OWN:
        table[a:b] = np.arange(at, at + b - a)
        at += b - a
    table[ord("0") : ord("9") + 1] = table[ord("0")]
    return table


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def pair_codes(text: str) -> np.ndarray:
    """Codes of the adjacent pairs, with the edge of the text at both ends."""
    kinds = class_table()[points(text)].astype(np.int64)
    kinds = np.concatenate(([EDGE], kinds, [EDGE]))
    return kinds[:-1] * N_CLASSES + kinds[1:]


def pair_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(code, n): occurrences of each pair over all distinct texts; summed in the tasks before the shuffle."""

    def count(batches):
        total = np.zeros(N_CLASSES * N_CLASSES, dtype=np.int64)
        for batch in batches:
            for t in batch["t"]:
                if t:
                    np.add.at(total, *np.unique(pair_codes(t), return_counts=True))
        code = np.flatnonzero(total)
        yield pd.DataFrame({"code": code, "n": total[code]})

    return docs.select(F.col(text).alias("t")).where("t is not null").distinct().mapInPandas(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


#: Pairs that bits are scaled to.  A larger corpus gives the same bits and so the same verdicts however large it grows;
#: a smaller one has no evidence for more than its own counts.
REFERENCE = 1e8


class PairModel:
    """Information of each pair and the threshold under which a pair is improbable."""

    def __init__(self, code: np.ndarray, n: np.ndarray, quantile: float = 0.15):
        counts = np.zeros((N_CLASSES, N_CLASSES))
        counts.flat[np.asarray(code, dtype=np.int64)] = n
        counts *= min(1.0, REFERENCE / max(counts.sum(), 1.0))
        total = max(counts.sum(), 1.0)
        left, right = counts.sum(1, keepdims=True), counts.sum(0, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            pmi = np.log2(counts * total / (left * right))
        mass = np.where(counts > 0, counts * np.maximum(np.nan_to_num(pmi, neginf=0, posinf=0), 0.05), 0.0)
        self.bits = np.log2(mass + 0.5).astype(np.float32)
        seen = np.flatnonzero(counts)
        order = np.argsort(self.bits.flat[seen], kind="stable")
        share = np.cumsum(counts.flat[seen][order]) / total
        self.threshold = float(self.bits.flat[seen][order][np.searchsorted(share, quantile)]) if len(seen) else 0.0

    def of(self, text: str, before: str = "", after: str = "") -> np.ndarray:
        """Information of the pairs of a passage with the characters next to it (edge of text if none)."""
        kinds = class_table()[points(before[-1:] + text + after[:1])].astype(np.int64)
        kinds = np.concatenate(([EDGE] if not before else [], kinds, [EDGE] if not after else [])).astype(np.int64)
        return self.bits[kinds[:-1], kinds[1:]]


def maximal_segments(score: np.ndarray, wanted: np.ndarray | None = None) -> list[tuple[int, int]]:
    """All maximum-scoring segments [i, j) of a sequence, disjoint, in order; only those near wanted positions if given.

    Stretches of one sign are merged to blocks first.  A segment can't cross a
    negative block that outweighs the best that ends before it or the best that
    starts after it, so the sequence falls into groups of few blocks; only
    groups of several blocks need the stack of candidates.
    """
    sign = np.concatenate(([False], score > 0, [False]))
    edge = np.flatnonzero(sign[1:] != sign[:-1])
    start, end = edge[::2], edge[1::2]  # of the positive blocks
    if not len(start):
        return []
    total = np.concatenate(([0.0], np.cumsum(score, dtype=np.float64)))
    plus, minus = total[end] - total[start], total[end[:-1]] - total[start[1:]]  # sums of blocks, weights of the gaps between
    before, after = plus.copy(), plus.copy()  # best sums that end with a block, and that start with one
    for best, own, gap, last in ((before[1:], plus[1:], minus, before[:-1]), (after[:-1], plus[:-1], minus, after[1:])):
        while True:
            new = own + np.maximum(0.0, last - gap)
            if np.array_equal(new, best):
                break
            best[:] = new
    cut = np.flatnonzero((minus >= before[:-1]) | (minus >= after[1:])) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(start)]))
    if wanted is not None:
        seen = np.concatenate(([0], np.cumsum(wanted)))
        near = seen[end[last - 1]] > seen[start[first]]
        first, last = first[near], last[near]
    out: list[tuple[int, int]] = []
    for f, n in zip(first.tolist(), last.tolist()):
        if n == f + 1:
            out.append((int(start[f]), int(end[f])))
        else:
            out += _stacked(start[f:n].tolist(), end[f:n].tolist(), total)
    return out


def _stacked(start: list[int], end: list[int], total: np.ndarray) -> list[tuple[int, int]]:
    """Maximum-scoring segments made of the given positive blocks; total: sums before each position."""
    found: list[tuple[int, int, float, float]] = []  # first, last, total before, total after
    for a, b in zip(start, end):
        item = (a, b, float(total[a]), float(total[b]))
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= item[2]:
                j -= 1
            if j < 0 or found[j][3] >= item[3]:
                found.append(item)
                break
            item = (found[j][0], item[1], found[j][2], item[3])
            del found[j:]
    return [(a, b) for a, b, _, _ in found]


# --- inverse mappings ------------------------------------------------------

# Single-byte encodings, by Python codec name.
SINGLE_BYTE = ("cp1252", "latin_1", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "iso8859_2", "cp1254", "koi8_r", "iso8859_15", "cp866", "cp1253")
# Stored encoding, and the encodings that its bytes get mistaken for.
SWAPS = {"cp1252": ("mac_roman", "cp437", "cp850", "cp1251", "cp1250", "iso8859_2", "latin_1", "koi8_r", "cp866", "cp1253"), "mac_roman": ("cp1252", "latin_1"), "cp850": ("cp1252", "latin_1"), "cp437": ("cp1252", "latin_1")}


@lru_cache(None)
def tables(codec: str) -> tuple[dict[str, int], list[str | None]]:
    """Character to byte and byte to character; bytes without a meaning stand for themselves as C1 controls."""
    chars: list[str | None] = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            chars.append(chr(b) if 0x80 <= b < 0xA0 else None)
    back = {c: b for b, c in enumerate(chars) if c is not None}
    if codec == "cp1252":
        back |= {chr(b): b for b in range(0x80, 0xA0) if chr(b) not in back}
    return back, chars


_MULTI = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")
_HIGH = re.compile(r"[^\x00-\x7f]+")


def as_utf8(run: str, codec: str) -> tuple[str, int, int]:
    """The run with its multi-byte sequences decoded; how many sequences were, and how many high characters were left."""
    back, _ = tables(codec)
    done = left = 0

    def stretch(m: re.Match) -> str:
        nonlocal done, left
        out, raw = [], m.group()
        i = 0
        while i < len(raw):
            for size in (2, 3, 4):
                part = raw[i : i + size]
                if len(part) == size and all(c in back for c in part) and _MULTI.fullmatch(b := bytes(back[c] for c in part)):
                    out.append(b.decode("utf-8"))
                    done += 1
                    i += size
                    break
            else:
                out.append(raw[i])
                left += 1
                i += 1
        return "".join(out)

    return _HIGH.sub(stretch, run), done, left


def swapped(run: str, read_as: str, stored_as: str) -> str | None:
    """The run if its bytes, read as one single-byte encoding, are read as the other; None if it can't be."""
    back, _ = tables(read_as)
    _, chars = tables(stored_as)
    out = []
    for c in run:
        if c < "\x80":
            out.append(c)
        elif c in back and (r := chars[back[c]]) is not None and not "\x80" <= r < "\xa0":
            out.append(r)
        else:
            return None
    return "".join(out)


class Restorer:
    """Restores one text after another; outcomes of runs met before are kept, up to a bound."""

    GAIN_SWAP = 2.0  # bits a pair by which a single-byte swap must improve a run
    GAIN_LONE = 7.0  # the same if only lone letters and symbols would change
    LOSS_UTF8 = 3.0  # bits a pair that a valid multi-byte decoding of a whole run may lose
    KEPT = 200_000

    def __init__(self, model: PairModel):
        self.model = model
        self.known: dict[tuple[str, str, str], list[tuple[str, str, float]]] = {}

    def runs(self, text: str) -> list[tuple[int, int]]:
        """Character spans of the improbable runs that hold a character beyond ASCII."""
        own = points(text)
        kinds = np.concatenate(([EDGE], class_table()[own].astype(np.int64), [EDGE]))
        score = self.model.threshold - self.model.bits[kinds[:-1], kinds[1:]]
        beyond = own > 0x7F
        high = np.concatenate(([0], np.cumsum(beyond)))
        wanted = np.zeros(len(own) + 1, dtype=bool)  # pair p is of the characters p - 1 and p; one more on either side, as runs grow
        for shift in (-1, 0, 1, 2):
            at = np.flatnonzero(beyond) + shift
            wanted[at[(at >= 0) & (at <= len(own))]] = True
        spans: list[tuple[int, int]] = []
        for i, j in maximal_segments(score, wanted):
            a, b = max(i - 1, 0), min(j, len(text))
            while a > 0 and text[a - 1] > "\x7f":  # a run ends where its high characters do
                a -= 1
            while b < len(text) and text[b] > "\x7f":
                b += 1
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
            else:
                spans.append((a, b))
        return [(a, b) for a, b in spans if high[b] > high[a]]

    @staticmethod
    def telling(around: str, k: int, new: str) -> bool:
        """Whether a swapped character is evidence: one inside a word, or one that stands alone and becomes a mark.

        A lone symbol that would become a lone letter tells little, a lone mark or space nothing.
        """
        if around[k].isspace():
            return False
        beside = any(c.isascii() and c.isalpha() for c in (around[k - 1], around[k + 1]))
        return beside or not new.isalpha()

    def outcomes(self, run: str, before: str, after: str) -> list[tuple[str, str, float]]:
        """(mapping, outcome, gain) of the mappings that the run allows."""
        key = (run, before, after)
        if key in self.known:
            return self.known[key]
        was = self.model.of(run, before, after)
        mean = float(was.mean())
        found: list[tuple[str, str, float]] = []
        for codec in SINGLE_BYTE:
            text, done, left = as_utf8(run, codec)
            name = f"utf8 as {codec}"
            if not done:
                continue
            again, more, _ = as_utf8(text, codec)
            if more:
                text, name = again, f"{name}, twice"
            now = self.model.of(text, before, after)
            if float(now.mean()) >= mean - (0.0 if left else self.LOSS_UTF8) and not any("\x80" <= c < "\xa0" for c in text):
                found.append((name, text, (float(now.mean()) - mean) + 4.0 * done - 2.0 * left))
        if not found:
            for stored, mistaken in SWAPS.items():
                for read in mistaken:
                    if (text := swapped(run, read, stored)) is None or text == run:
                        continue
                    changed = [k for k, (x, y) in enumerate(zip(run, text)) if x != y]
                    around = "".join((before[-1:] or " ", run, after[:1] or " "))
                    needed = self.GAIN_SWAP
                    if not any(self.telling(around, k + 1, text[k]) for k in changed):
                        if any(unicodedata.category(run[k])[0] in "PZ" for k in changed):
                            continue
                        needed = self.GAIN_LONE
                    shift = 1  # pairs p and p + 1 touch character p; before or the edge always stands at 0
                    touched = sorted({k + d for k in changed for d in (0, shift)})
                    now = self.model.of(text, before, after)[touched]
                    gain = float((now - was[touched]).mean())
                    if gain >= needed and float(now.min()) > (2.0 if gain < 5.0 else 0.0) and float(was[touched].mean()) < self.model.threshold:
                        found.append((f"{stored} as {read}", text, gain))
        if len(self.known) < self.KEPT:
            self.known[key] = found
        return found

    def restore(self, text: str) -> tuple[str, str, int] | None:
        """Restored text, mapping used, and characters lost; None if the text is sound."""
        if text.isascii():
            return None
        lost = text.count("�")
        options = []
        gains: dict[str, float] = {}
        for a, b in self.runs(text):
            found = self.outcomes(text[a:b], text[a - 1 : a] if a else "", text[b : b + 1])
            if found:
                options.append((a, b, found))
                for name, _, gain in found:
                    gains[name] = gains.get(name, 0.0) + gain
        if not options:
            return (text, "lost", lost) if lost else None
        rank = sorted(gains, key=lambda k: (-gains[k], k))
        out, at, used = [], 0, set()
        for a, b, found in options:
            name, new, _ = min(found, key=lambda f: (rank.index(f[0]), f[0]))
            out += [text[at:a], new]
            at = b
            used.add(name)
        return "".join([*out, text[at:]]), "; ".join(sorted(used)), lost


def restore_encoding(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", quantile: float = 0.15) -> DataFrame:
    """(id, mapping, lost, restored): one row for each affected text."""
    spark = docs.sparkSession
    # at most N_CLASSES ** 2 rows by construction, a few thousand in practice
    table = pair_counts(docs, text).toPandas()
    model = spark.sparkContext.broadcast(PairModel(table["code"].to_numpy(), table["n"].to_numpy(), quantile))

    def work(batches):
        restorer = Restorer(model.value)
        for batch in batches:
            rows = [(i, r[1], r[2], r[0]) for i, t in zip(batch["id"], batch["t"]) if (r := restorer.restore(t))]
            yield pd.DataFrame(rows, columns=["id", "mapping", "lost", "restored"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).where("id is not null and t is not null")
    found = rows.where(F.col("t").rlike("[^\\x00-\\x7f]")).mapInPandas(work, f"id {kind}, mapping string, lost long, restored string")
    return found.distinct().withColumnRenamed("id", doc_id)
