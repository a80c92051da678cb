"""Random draws that any engine can make again: the first 52 bits of md5 over a name and a counter."""

from __future__ import annotations

import math
from hashlib import md5

import numpy as np

_SCALE = float(1 << 52)


class HashDraws:
    """A stream of draws named by its seeds; draw i is md5('seed:seed:i'). The methods are those of numpy's generators that are used here."""

    def __init__(self, *seeds: object) -> None:
        self.name, self.at = ":".join(map(str, seeds)).encode(), 0

    def random(self, size: int | tuple[int, ...] | None = None) -> np.ndarray | float:
        """Numbers in [0, 1)."""
        shape = () if size is None else (size,) if isinstance(size, int | np.integer) else tuple(size)
        n = math.prod(shape)
        first, self.at = self.at, self.at + n
        u = np.array([int(md5(b"%b:%d" % (self.name, i)).hexdigest()[:13], 16) for i in range(first, self.at)], float) / _SCALE
        return float(u[0]) if size is None else u.reshape(shape)

    def integers(self, low: int, high: int, size: int | tuple[int, ...] | None = None) -> np.ndarray | int:
        """Whole numbers from low on, below high."""
        u = np.floor(np.asarray(self.random(size)) * (high - low)).astype(np.int64) + low
        return int(u) if size is None else u

    def standard_normal(self, size: int) -> np.ndarray:
        """Normal numbers, each of two draws, by Box and Muller."""
        u = self.random((size, 2))
        return np.sqrt(-2 * np.log(1 - u[:, 0])) * np.cos(2 * math.pi * u[:, 1])

    def permutation(self, n: int) -> np.ndarray:
        return np.argsort(self.random(n), kind="stable")

    def choice(self, n: int, size: int, replace: bool = False) -> np.ndarray:
        return self.integers(0, n, size) if replace else self.permutation(n)[:size]


def draw_sql(name: str, i: str) -> str:
    """SQL of draw i of the stream that the SQL expression `name` names, in [0, 1)."""
    return f"(('0x' || substr(md5({name} || ':' || ({i})), 1, 13))::bigint / 4503599627370496.0::double)"
