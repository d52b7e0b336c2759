"""SetSketch: registers of exponentially spaced, truncated minima, computed for many sets at once.

Each element gives every register an exponentially distributed value; a register keeps the least value of its set, as
the whole number 1 - log_BASE(value) cut to 0 .. TOP. Sketches of two sets merge by the registers' maxima, and with BASE
near 1 two registers are equal about as often as the sets' Jaccard similarity says.
"""

from __future__ import annotations

import math

import numpy as np

from quillon.llm.shingles import U64, mixed

#: Registers, rows of a band, and bands: 28 of 6, from the first 168 registers; estimates use all. A pair of similarity
#: 0.85 shares no band with probability 2e-6.
REGISTERS, ROWS, BANDS = 400, 6, 28
#: Base of the spacing, rate of the values, and the largest register value.
BASE, RATE, TOP = 1.001, 20.0, 65_534


def sketches(elements: np.ndarray, first: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Registers (uint16, a row for each set) of the sets elements[first[i]:first[i+1]]; an empty set has zeros.

    An element's values are made in rising order and dealt to the registers in a random order of its own (sampling
    spacings of an ordered exponential sample). An element stops once its values exceed all minima of its set, so the
    larger a set, the fewer values an element costs: in total about n + m log m for a set of n.
    """
    sets = len(first) - 1
    least = np.full(sets * m, np.inf)
    owner = np.repeat(np.arange(sets), np.diff(first))
    seed = elements
    value = np.zeros(len(seed))
    where = (mixed(seed ^ U64(0xA0761D6478BD642F)) % U64(m)).astype(np.int64)
    step = (mixed(seed ^ U64(0xE7037ED1A0B428DB)) % U64(m - 1)).astype(np.int64) + 1
    for j in range(m):
        if not len(seed):
            break
        u = (mixed(seed + U64((j + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> U64(11)).astype(np.float64) * 2.0**-53
        value = value - np.log1p(-u) / (RATE * (m - j))
        np.minimum.at(least, owner * m + where, value)
        limit = least.reshape(sets, m).max(axis=1)
        on = value < limit[owner]
        seed, value, owner, step = seed[on], value[on], owner[on], step[on]
        where = where[on] + step
        where -= m * (where >= m)
    with np.errstate(divide="ignore"):
        k = np.floor(1.0 - np.log(least) / math.log(BASE))
    return np.clip(k, 0, TOP).astype(np.uint16).reshape(sets, m)


def bands(registers: np.ndarray, rows: int = ROWS, most: int = BANDS) -> np.ndarray:
    """A 64-bit hash of each band of `rows` register values and the band's number."""
    sets, m = registers.shape
    part = registers[:, : min(m - m % rows, rows * most)].astype(np.uint64).reshape(sets, -1, rows)
    h = np.tile(mixed(np.arange(1, part.shape[1] + 1, dtype=np.uint64)), (sets, 1))
    for k in range(rows):
        h = mixed(h * U64(0x9E3779B97F4A7C15) + part[:, :, k] + U64(k + 1))
    return h


_grid = np.concatenate([np.linspace(0.0, 0.5, 11)[:-1], np.linspace(0.5, 1.0, 51)])


def likeliest(larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The similarity in a grid of steps of 0.01 (0.05 below a half) under which the numbers of registers where the
    first sketch is larger, smaller or equal are likeliest, given both sets' sizes."""
    u, v = na / (na + nb), nb / (na + nb)
    top = np.minimum(u / v, v / u)
    j = np.minimum(_grid[None, :], top[:, None])
    c = (BASE - 1) / BASE
    p = lambda x: np.maximum(-np.log1p(-c * x) / math.log(BASE), 1e-12)
    a, b = p(np.maximum(u[:, None] - v[:, None] * j, 0)), p(np.maximum(v[:, None] - u[:, None] * j, 0))
    same = np.maximum(1.0 - a - b, 1e-12)
    fit = larger[:, None] * np.log(a) + smaller[:, None] * np.log(b) + equal[:, None] * np.log(same)
    return np.take_along_axis(j, fit.argmax(axis=1)[:, None], 1)[:, 0]


def estimates(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarities of rows of two register arrays."""
    return likeliest((a > b).sum(1), (a < b).sum(1), (a == b).sum(1), na.astype(float), nb.astype(float))
