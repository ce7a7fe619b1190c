"""Evaluation texts leaking into a corpus, by greedy string tiling.

Items offer the rolling (Karp-Rabin) hashes of all their windows of
``min_match`` words.  Windows of documents that share a hash are the seeds; for
each document and item with a seed, greedy string tiling repeatedly marks the
longest common passages that overlap no earlier tile, down to ``min_match``
words.  The longest length is found by bisection, hashing all unmarked windows of
a length at once, so a text that repeats itself costs no more than another.  The share of the item under tiles is its coverage, whatever the order
of the passages, so reordered leaks are found too.

The items' windows are sent to the executors only if there are at most
``SEEDS_IN_MEMORY`` of them; beyond that, the documents' windows are joined
with them instead, and only documents with a seed are read on.  A bitmap of the
items' windows drops most others before the exchange.

Defined results: null texts and ids are no case, repeated rows count once,
items shorter than ``min_match`` words can't leak; whole texts are searched.
Extra columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaloom.llm.bitmaps import bitmap, marked_in
from qaloom.operators.lineage import cut

SEEDS_IN_MEMORY = 1_000_000
_WORD = re.compile(r"[^\W_]+")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word) | 1
        return value


def numbers(text: str, known: _Words) -> np.ndarray:
    """The words of a text as numbers."""
    return np.array([known[w] for w in _WORD.findall(text.lower())], dtype=np.uint64)


_POWERS: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the factor and of its inverse, at least ``n`` of each, kept for all texts."""
    if len(_POWERS[0]) < n:
        for k, f in enumerate((int(_FACTOR), pow(int(_FACTOR), -1, 1 << 64))):
            _POWERS[k] = np.cumprod(np.full(max(n, 4096, 2 * len(_POWERS[k])), np.uint64(f), dtype=np.uint64))
    return _POWERS


def prefix_sums(x: np.ndarray) -> np.ndarray:
    """Sums of word * factor**position before each position, modulo 2**64."""
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * _powers(len(x))[0][: len(x)], dtype=np.uint64)))


def hashes_of(prefix: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``size`` words, by differences of prefix sums.

    The sum of word * factor**position over a window, shifted to the window's
    start by the factor's inverse, depends on its words alone.
    """
    n = len(prefix) - size
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    return ((prefix[size:] - prefix[:-size]) * _powers(n)[1][:n]).view(np.int64)


def window_hashes(x: np.ndarray, size: int) -> np.ndarray:
    return hashes_of(prefix_sums(x), size)


def _free(marked: np.ndarray, size: int) -> np.ndarray:
    """Starts of the windows that hold no marked word."""
    before = np.concatenate(([0], np.cumsum(marked)))
    return np.flatnonzero(before[size:] == before[: len(marked) - size + 1]) if size <= len(marked) else np.zeros(0, np.int64)


def tile(doc: np.ndarray, item: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Tiles (start in document, start in item, length), the longest first.

    For a length, windows of unmarked words are compared by their hashes.  The
    longest length with a match is bisected, as shorter windows of a match match
    too; its matches are checked word by word and marked from left to right.
    Each pass marks a tile or lowers the length, and a tile uses up words of the
    item, so there are few passes.
    """
    marked_doc, marked_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    of_doc, of_item = prefix_sums(doc), prefix_sums(item)
    tiles: list[tuple[int, int, int]] = []

    def matches(size: int):
        i, j = _free(marked_doc, size), _free(marked_item, size)
        if not len(i) or not len(j):
            return None
        h, g = hashes_of(of_doc, size)[i], hashes_of(of_item, size)[j]
        hit = np.isin(h, g)
        return (i[hit], h[hit], j, g) if hit.any() else None

    most = min(len(doc), len(item))
    while most >= min_match:
        low, high, found = min_match - 1, most, None  # low has a match (or is too short), high + 1 has none
        while low < high:
            middle = (low + high + 1) // 2
            if got := matches(middle):
                low, found = middle, got
            else:
                high = middle - 1
        if found is None:
            return tiles
        starts, hashes, item_starts, item_hashes = found
        free: dict[int, list[int]] = {}
        for j, g in zip(item_starts[::-1].tolist(), item_hashes[::-1].tolist()):
            free.setdefault(g, []).append(j)
        end = 0
        for i, h in zip(starts.tolist(), hashes.tolist()):
            there = free.get(h)
            if i < end or not there:
                continue
            while there and marked_item[there[-1] : there[-1] + low].any():
                there.pop()
            if there and np.array_equal(doc[i : i + low], item[there[-1] : there[-1] + low]):
                j = there.pop()
                marked_doc[i : i + low] = marked_item[j : j + low] = True
                tiles.append((i, j, low))
                end = i + low
        most = low - 1
    return tiles


_RESULT = "doc_id {doc}, item_id {item}, n_tiles int, longest int, matched_words int, coverage double"


def _row(doc_id, item_id, doc: np.ndarray, item: np.ndarray, min_match: int):
    tiles = tile(doc, item, min_match)
    if tiles:
        matched = sum(n for _, _, n in tiles)
        return doc_id, item_id, len(tiles), tiles[0][2], matched, matched / len(item)
    return None


_COLUMNS = ["doc_id", "item_id", "n_tiles", "longest", "matched_words", "coverage"]


def leaks(docs: DataFrame, items: DataFrame, min_match: int = 12, min_coverage: float = 0.0, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", seeds_in_memory: int = SEEDS_IN_MEMORY) -> DataFrame:
    """(doc_id, item_id, n_tiles, longest, matched_words, coverage): documents and the items that they leak."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).where("doc_id is not null and t is not null")
    i = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("t")).where("item_id is not null and t is not null").distinct()
    schema = _RESULT.format(doc=docs.schema[doc_id].dataType.simpleString(), item=items.schema[item_id].dataType.simpleString())
    n_words = F.size(F.regexp_extract_all(F.lower("t"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    n_seeds = i.agg(F.sum(F.greatest(n_words - (min_match - 1), F.lit(0)))).first()[0] or 0
    i = i.where(n_words >= min_match)  # shorter ones can't leak
    found = _by_broadcast(d, i, min_match, schema) if n_seeds <= seeds_in_memory else _by_join(d, i, min_match, schema)
    best = F.max(F.struct("coverage", "longest", "n_tiles", "matched_words")).alias("b")  # of repeated ids with other texts, the clearest
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.n_tiles", "b.longest", "b.matched_words", "b.coverage").where(F.col("coverage") >= min_coverage)


def _by_broadcast(d: DataFrame, i: DataFrame, min_match: int, schema: str) -> DataFrame:
    known, texts, seeds, owner = _Words(), [], [], []
    for row in i.collect():  # each has a seed at least, and their number was checked
        x = numbers(row["t"], known)
        if len(x) >= min_match:
            h = window_hashes(x, min_match)
            seeds.append(h)
            owner.append(np.full(len(h), len(texts)))
            texts.append((row["item_id"], x))
    h = np.concatenate(seeds) if seeds else np.zeros(0, np.int64)
    o = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    order = np.argsort(h, kind="stable")
    index = d.sparkSession.sparkContext.broadcast((h[order], o[order], texts))

    def work(batches):
        seeds, owners, texts = index.value
        known = _Words()
        for batch in batches:
            rows = []
            for doc, t in zip(batch["doc_id"], batch["t"]):
                x = numbers(t, known)
                h = window_hashes(x, min_match)
                if not len(h) or not len(seeds):
                    continue
                low = np.searchsorted(seeds, h, "left")
                hit = np.flatnonzero(seeds[np.minimum(low, len(seeds) - 1)] == h)
                if len(hit):
                    first = np.unique(low[hit])  # each window once, however often the document repeats it
                    last = np.searchsorted(seeds, seeds[first], "right")
                    for k in np.unique(np.concatenate([owners[a:b] for a, b in zip(first, last)])).tolist():
                        if row := _row(doc, texts[k][0], x, texts[k][1], min_match):
                            rows.append(row)
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return d.mapInPandas(work, schema)


def _by_join(d: DataFrame, i: DataFrame, min_match: int, schema: str) -> DataFrame:
    def windows(key: str, kind: str, marked=None):
        def work(batches):
            known = _Words()
            for batch in batches:
                for k, t in zip(batch[key], batch["t"]):
                    h = np.unique(window_hashes(numbers(t, known), min_match))
                    if marked is not None:
                        h = h[marked_in(marked.value, h)]
                    yield pd.DataFrame({key: [k] * len(h), "h": h})

        return work, f"{key} {kind}, h long"

    kinds = dict((x.split()[0], x.split()[1]) for x in schema.split(", "))
    of_items = cut(i.mapInPandas(*windows("item_id", kinds["item_id"])).distinct())
    marked = d.sparkSession.sparkContext.broadcast(bitmap(of_items, "h"))
    of_docs = d.mapInPandas(*windows("doc_id", kinds["doc_id"], marked))
    pairs = of_docs.join(of_items, "h").select("doc_id", "item_id").distinct()
    whole = pairs.join(d, "doc_id").join(i.withColumnRenamed("t", "item_text"), "item_id")

    def work(batches):
        known = _Words()
        for batch in batches:
            rows = [_row(a, b, numbers(t, known), numbers(u, known), min_match) for a, b, t, u in zip(batch["doc_id"], batch["item_id"], batch["t"], batch["item_text"])]
            yield pd.DataFrame([r for r in rows if r], columns=_COLUMNS)

    return whole.mapInPandas(work, schema)
