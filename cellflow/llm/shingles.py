"""Five-word shingles of whole texts as 64-bit hashes, in numpy over the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import ship

WIDTH = 5
#: Bytes of text that are hashed at a time.
CHUNK = 1_000_000
_STEP = 0x9E3779B97F4A7C15
_INVERSE = pow(_STEP, -1, 1 << 64)
_cache: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int, name: str) -> np.ndarray:
    have = _cache.get(name)
    if have is None or len(have) < n:
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        have = _cache[name] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte: whether it separates words, its random value (A-Z as a-z); and a factor for each word of a shingle."""
    if "value" not in _cache:
        low = np.arange(256)
        low[65:91] += 32
        space = np.zeros(256, bool)
        space[[32, 9, 10, 11, 12, 13]] = True
        _cache["space"], _cache["value"] = space, mix(low.astype(np.uint64) + np.uint64(1))
        _cache["factor"] = mix(np.arange(101, 101 + 2 * WIDTH, dtype=np.uint64)) | np.uint64(1)
    return _cache["space"], _cache["value"], _cache["factor"]


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts as UTF-8, CHUNK bytes or one text at a time, each with the number of the first."""
    first, size, out = 0, 0, []
    for k, t in enumerate(texts):
        b = t.encode("utf-8", "replace") if isinstance(t, str) else b""
        if out and size + len(b) > CHUNK:
            yield first, out
            first, size, out = k, 0, []
        out.append(b)
        size += len(b) + 1
    if out:
        yield first, out


def shingle_sets(raw: list[bytes]) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes; with under five words the whole sequence is one, without words there is none."""
    space, value, factor = _tables()
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    begins = np.cumsum([0, *[len(b) + 1 for b in raw]])
    gap = space[data]
    starts = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    ends = np.flatnonzero(gap[1:] & ~gap[:-1]) + 1
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in raw]
    total = np.concatenate(([np.uint64(0)], np.cumsum(value[data] * _powers(_STEP, len(data), "up"), dtype=np.uint64)))
    word = mix((total[ends] - total[starts]) * _powers(_INVERSE, len(data), "down")[starts] + (ends - starts).astype(np.uint64))
    at = np.searchsorted(starts, begins)
    n = len(word)
    five = np.zeros(max(0, n - WIDTH + 1), np.uint64)
    for k in range(WIDTH):
        five += word[k : n - WIDTH + 1 + k] * factor[k]
    five = mix(five)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= WIDTH:
            s = np.sort(five[a : b - WIDTH + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            whole = np.append(word[a:b], np.uint64(b - a)) * np.append(factor[WIDTH : WIDTH + b - a], factor[-1])
            out.append(mix(whole.sum(dtype=np.uint64, keepdims=True)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest(s: np.ndarray) -> int:
    """A 64-bit fingerprint of a whole set, signed as Spark's long."""
    return int(mix(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s))).view(np.int64)[0])


ship(__name__)
