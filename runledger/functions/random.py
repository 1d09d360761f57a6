"""Deterministic jitter: the splitmix64 generator over (seed, counter), vectorised on 64-bit words that wrap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType

#: Fixed values of splitmix64, and of the seed of the ids.
GAMMA, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
UUID_SALT = 0x5DEECE66D


def splitmix64(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(GAMMA)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


@F.pandas_udf(DoubleType())
def jitter(seed: pd.Series, counter: pd.Series) -> pd.Series:
    """A fraction in [0, 1) from the top 53 bits of the mix of seed and counter."""
    mixed = splitmix64(seed.to_numpy(np.int64).view(np.uint64) ^ splitmix64(counter.to_numpy(np.int64).view(np.uint64)))
    return pd.Series((mixed >> np.uint64(11)).astype(np.float64) / 2.0**53)


@F.pandas_udf(LongType())
def next_seed(seed: pd.Series) -> pd.Series:
    """The seed of a run's successor: the mix of its own, without the sign bit."""
    return pd.Series((splitmix64(seed.to_numpy(np.int64).view(np.uint64)) & np.uint64(2**63 - 1)).view(np.int64))


def _stream(seed: pd.Series, nth: pd.Series) -> np.ndarray:
    """The nth word (from 1) of a run's stream: its state grows by GAMMA a word, so any word is at hand without those before."""
    with np.errstate(over="ignore"):
        return splitmix64(seed.to_numpy(np.int64).view(np.uint64) + np.uint64(GAMMA) * (nth.to_numpy(np.int64).view(np.uint64) - np.uint64(1)))


@F.pandas_udf(LongType())
def random_word(seed: pd.Series, nth: pd.Series) -> pd.Series:
    """The nth number of 63 bits that a workflow with this seed draws."""
    return pd.Series((_stream(seed, nth) >> np.uint64(1)).view(np.int64))


@F.pandas_udf(StringType())
def random_uuid(seed: pd.Series, nth: pd.Series) -> pd.Series:
    """The nth UUID (version 4) that a workflow with this seed makes: 16 bytes of its id stream, of whose words of 63 bits
    seven bytes each are read, the lowest first."""
    import uuid

    salted, n = pd.Series(seed.to_numpy(np.int64) ^ np.int64(UUID_SALT)), nth.to_numpy(np.int64)
    columns = []
    for i in range(16):
        at = 16 * (n - 1) + i
        word = _stream(salted, pd.Series(at // 7 + 1)) >> np.uint64(1)
        columns.append((word >> (8 * (at % 7)).astype(np.uint64) & np.uint64(255)).astype(np.uint8))
    return pd.Series([str(uuid.UUID(bytes=x.tobytes(), version=4)) for x in np.stack(columns, 1)])
