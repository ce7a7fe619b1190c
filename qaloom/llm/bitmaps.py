"""Bitmaps of hashes: which rows can't find a partner is seen where they arise, before any exchange.

A bitmap is put together by the tasks and comes to the driver in pieces of
packed bits, never as rows of numbers; it has at most a given number of bits, so
it can be sent to all executors.  It never misses a hash that was put in; the
fuller it is, the more others it lets through, for the join after it to decide.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BITS = 1 << 27
PIECE = 1 << 20  # bits in a row that goes to the driver


def bitmap(rows: DataFrame, hash_: str, most_bits: int = MOST_BITS) -> np.ndarray:
    """Bits, in words of 32, of the hashes (64-bit numbers) in a column: 16 bits for each row, at most ``most_bits``."""
    bits = min(most_bits, max(1 << 16, 1 << (16 * rows.count()).bit_length()))
    piece = min(bits, PIECE)
    place = F.shiftrightunsigned(hash_, 20).bitwiseAND(F.lit(bits - 1))

    def work(batches):
        pieces: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch["p"].to_numpy()
            of = at // piece
            for k in np.unique(of).tolist():
                p = at[of == k] % piece
                np.bitwise_or.at(pieces.setdefault(k, np.zeros(piece >> 3, dtype=np.uint8)), p >> 3, np.left_shift(1, p & 7).astype(np.uint8))
        for k, b in pieces.items():
            yield pd.DataFrame({"piece": [k], "bits": [b.tobytes()]})

    places = rows.select(place.alias("p")).repartition(F.expr(f"p div {piece}L"))
    out = np.zeros(bits >> 3, dtype=np.uint8)
    for row in places.mapInPandas(work, "piece long, bits binary").collect():  # most_bits / 8 bytes at most, if a piece is made by one task
        out[row["piece"] * (piece >> 3) :][: piece >> 3] |= np.frombuffer(row["bits"], dtype=np.uint8)
    return out.view("<u4")


def marked_in(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Mask of the hashes that may have been put in."""
    place = (hashes.view(np.uint64) >> np.uint64(20)) & np.uint64(len(words) * 32 - 1)
    return (words[place >> np.uint64(5)] >> (place & np.uint64(31)).astype(np.uint32)) & 1 > 0
