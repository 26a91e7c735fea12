"""What the operators of this subpackage share: table reads, byte classes and word hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

# ASCII white space that separates words, and the bytes of item words.
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

LOWER_ASCII = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
#: Lower-cases A-Z and makes a space of every byte that is no item-word byte.
ITEM_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else (c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20)
    for c in range(256)
)

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE_BYTES)] = True

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_VALUE = np.random.RandomState(20240229).randint(1, 2**63 - 1, 256).astype(np.uint64) | np.uint64(1)
_powers = {"n": 0, "up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, n: int) -> list[str]:
    """n names of columns that df lacks."""
    taken = {c.lower() for c in df.columns}
    return [x for i in range(len(taken) + n) if (x := f"own_{i}") not in taken][:n]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base of the rolling hash, and of its inverse (modulo 2**64)."""
    if _powers["n"] < n:
        n = max(2 * n, 1 << 16)
        up, down = np.full(n, _BASE), np.full(n, _INVERSE)
        up[0] = down[0] = 1
        _powers.update(n=n, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] the sum of value(byte k) * base**k over i <= k < j (modulo 2**64)."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * up[: len(data)], out=out[1:])
    return out


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are no white space."""
    edge = np.diff(np.concatenate(([1], _IS_SPACE[data].view(np.int8), [1])))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word of the text, in order."""
    starts, ends = word_spans(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    h = prefix_hash(data)
    _, down = powers(len(data) + 1)
    return mix((h[ends] - h[starts]) * down[starts])


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every run of n words; none if there are fewer words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    k = len(words) - n + 1
    out = np.zeros(k, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + words[i : i + k] + np.uint64(i + 1))
    return out
