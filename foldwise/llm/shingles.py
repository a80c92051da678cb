"""Word shingle sets and their minhashes, in numpy over the bytes of whole Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at once; a longer text is taken in parts that end between words.
BLOCK = 1 << 18
#: More bytes than a block has, unless a single word is that long.
TOP = 1 << 19
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
#: Words of so many bytes are hashed by blake2b: for long ones polynomials modulo 2**64 can be made to agree on purpose.
LONG_WORD = 512

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def draws(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random words."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed))


_BYTE = draws(1, 256)


@lru_cache(1)
def _powers(n: int) -> np.ndarray:
    """_BASE to the powers 0 to n - 1, modulo 2**64."""
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(_BASE, have, 1 << 64))
        have *= 2
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of bytes but white space, A-Z in lower case) of texts laid end to end,
    and the number of words before each start."""
    low = _LOWER[data]
    solid = ~_GAP[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[starts] = True
    begin = solid & np.concatenate([[True], ~solid[:-1]]) | solid & edge[:-1]
    end = solid & (np.concatenate([~solid[1:], [True]]) | edge[1:])
    a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
    # the sum of byte codes times powers, brought to the same power for every word
    if len(low) < TOP:
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[low] * _powers(TOP)[: len(low)], dtype=np.uint64)])
        h = (sums[b] - sums[a]) * _powers(TOP)[TOP - 1 - a]
    else:
        h = np.array([_polynomial(low[x : min(y, x + LONG_WORD)]) for x, y in zip(a, b, strict=True)], np.uint64)
    for k in np.flatnonzero(b - a >= LONG_WORD):
        h[k] = np.frombuffer(hashlib.blake2b(low[a[k] : b[k]].tobytes(), digest_size=8).digest(), np.uint64)[0]
    return mix(h ^ ((b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))), np.searchsorted(a, starts)


def _polynomial(word: np.ndarray) -> int:
    """The same sum for one short word."""
    return int((_BYTE[word] * _powers(TOP)[: len(word)]).sum(dtype=np.uint64)) * int(_powers(TOP)[TOP - 1]) & 0xFFFFFFFFFFFFFFFF


def _parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(text, from, to): parts of BLOCK bytes or up to the next white space."""
    for i, (a, b) in enumerate(zip(offsets, offsets[1:], strict=False)):
        while b - a > BLOCK:
            cut = a + BLOCK
            while cut < b and not _GAP[data[cut]]:
                cut += 1
            yield i, a, cut
            a = cut
        yield i, a, b


def word_lists(texts: pa.Array) -> Iterator[list[np.ndarray]]:
    """Word hashes of each text, for runs of texts of about BLOCK bytes; a null has none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] and len(texts) else np.empty(0, np.uint8)
    held: list[tuple[int, int, int]] = []
    got: dict[int, list[np.ndarray]] = {}

    def flush() -> None:
        if held:
            flat = np.concatenate([data[a:b] for _, a, b in held])
            starts = np.concatenate([[0], np.cumsum([b - a for _, a, b in held])]).astype(np.int64)
            h, at = word_hashes(flat, starts)
            for (i, _, _), x, y in zip(held, at, at[1:], strict=False):
                got.setdefault(i, []).append(h[x:y])
            held.clear()

    done = size = 0
    for part in _parts(data, offsets):
        if size + part[2] - part[1] > BLOCK:
            flush()
            size = 0
            if part[0] > done:
                yield [_one(got.pop(i)) for i in range(done, part[0])]
                done = part[0]
        held.append(part)
        size += part[2] - part[1]
    flush()
    yield [_one(got.pop(i)) for i in range(done, len(texts))]


def _one(parts: list[np.ndarray]) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of the n-word shingles, sorted; of fewer words, the whole sequence's; of none, none."""
    if not len(words):
        return words
    k = min(n, len(words))
    h = words[: len(words) - k + 1]
    for i in range(1, k):
        h = mix(h) + words[i : len(words) - k + 1 + i]
    return np.unique(h)


def minhashes(sets: list[np.ndarray], k: int, seed: int = 3) -> np.ndarray:
    """k minhashes of each set that isn't empty, by row."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.zeros((len(sets), k), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        a, b = draws(seed, k) | np.uint64(1), draws(seed + 1, k)
        for j in range(k):
            out[full, j] = np.minimum.reduceat(flat * a[j] + b[j], starts)
    return out


def fingerprint(s: np.ndarray) -> bytes:
    """128 bits of a set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()
