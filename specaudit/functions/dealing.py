"""Permutations of places by a key: any place's image alone, without an order of all of them.

A permutation of 0 .. n - 1 is a Feistel network of four rounds over a grid that is hardly larger than n, applied until the image lies below
n. Its rounds use whole numbers below 2^63 only, so any engine gives the same; see ``queries/sqlmath.py`` for it in SQL.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 1 << 32
ROUNDS = 4
#: Steps between the keys of rounds, and the factor of the mixing of 32-bit numbers.
ROUND_STEP, MIX = 0x9E3779B1, 0x45D9F3B
#: Factors of what a key is made of, and its bound.
SEED_STEP, DRAW_STEP, BIN_STEP, KEYS = 1_000_003, 15_485_863, 32_452_843, 1 << 31
#: The bin that stands for all genes, where a set's own bins have too few.
ALL_BINS = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = ((x ^ (x >> 16)) * MIX) & (WORD - 1)
    return x ^ (x >> 16)


def dealt_places(place: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The images of places below n under the permutations of the keys."""
    place, n, key = (np.asarray(v, np.int64) for v in (place, n, key))
    a = np.ceil(np.sqrt(n)).astype(np.int64)
    b = -(-n // np.maximum(a, 1))
    keys = [mixed((key + r * ROUND_STEP) % WORD) for r in range(ROUNDS)]
    out, todo = place.copy(), np.flatnonzero(n > 0)
    while len(todo):
        left, right = np.divmod(out[todo], b[todo])
        for r, k in enumerate(keys):
            if r % 2:
                right = (right + mixed((left + k[todo]) & (WORD - 1))) % b[todo]
            else:
                left = (left + mixed((right + k[todo]) & (WORD - 1))) % a[todo]
        out[todo] = left * b[todo] + right
        todo = todo[out[todo] >= n[todo]]
    return out


def dealt(place: Column, n: Column, key: Column) -> Column:
    """Column of :func:`dealt_places`."""

    @F.pandas_udf("long")
    def images(p: pd.Series, m: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series(dealt_places(p.to_numpy(), m.to_numpy(), k.to_numpy()))

    return images(place.cast("long"), n.cast("long"), key.cast("long"))


def deal_key(seed: int, draw: Column, bin_: Column | None = None, name: Column | None = None) -> Column:
    """The key of a draw: of its number, and maybe of a bin and a name."""
    out = F.lit(seed * SEED_STEP).cast("long") + draw.cast("long") * DRAW_STEP
    if bin_ is not None:
        out = out + bin_.cast("long") * BIN_STEP
    if name is not None:
        out = out + F.conv(F.substring(F.md5(name.cast("string")), 1, 7), 16, 10).cast("long")
    return F.pmod(out, F.lit(KEYS))
