"""Parts of one text that lie within other parts of it, at any number of parts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to so many parts all pairs are looked at, which is faster for a few.
FEW = 48
#: Odd, as the powers of it must not vanish in 64 bits.
BASE = 0x9E3779B97F4A7C15


def contained(parts: list[str]) -> np.ndarray:
    """Which of some distinct strings lie within another one.

    Parts of one length are looked up among the rolling hashes of all places
    of all parts: time grows with the size of the text times the number of
    different lengths, not with the square of the number of parts.  What the hashes
    find is compared letter by letter.
    """
    if len(parts) <= FEW:
        return np.array([any(a in b for b in parts if b is not a) for a in parts], dtype=bool)
    inside = np.zeros(len(parts), dtype=bool)
    text = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    lengths = np.array([len(p) for p in parts])
    starts = np.r_[0, lengths.cumsum()[:-1]]
    ends = np.repeat(starts + lengths, lengths)  # of the part that a place lies in
    with np.errstate(over="ignore"):
        # prefix sums of letter * BASE ** place; a window's sum times BASE ** (size - its start) does not depend on its start
        powers = np.cumprod(np.full(len(text), BASE, dtype=np.uint64))
        prefix = np.r_[np.uint64(0), np.cumsum((text + np.uint64(1)) * powers, dtype=np.uint64)]
        back = powers[::-1]
        for size in np.unique(lengths):
            (own,) = np.nonzero(lengths == size)
            if size == 0:
                inside[own] = len(parts) > 1
                continue
            places = np.arange(len(text) - size + 1)
            places = places[places + size <= ends[places]]
            hashes = (prefix[places + size] - prefix[places]) * back[places]
            wanted = (prefix[starts[own] + size] - prefix[starts[own]]) * back[starts[own]]
            others = np.flatnonzero(np.isin(hashes, wanted) & ~np.isin(places, starts[own]))
            found, first = np.unique(hashes[others], return_index=True)
            at = dict(zip(found.tolist(), places[others[first]].tolist()))

            def equal(place: int, k: int, size: int = size) -> bool:
                return np.array_equal(text[place : place + size], text[starts[k] : starts[k] + size])

            for k, h in zip(own.tolist(), wanted.tolist()):
                if h in at:  # the first place will do, unless its hash is that of another text
                    inside[k] = equal(at[h], k) or any(equal(p, k) for p in places[others[hashes[others] == np.uint64(h)]])
    return inside


def uncontained(parts: Column) -> Column:
    """The distinct strings of an array that do not lie within another of them, in order."""

    @F.pandas_udf("array<string>")
    def run(rows: pd.Series) -> pd.Series:
        out = []
        for row in rows:
            if row is None:
                out.append(None)
                continue
            distinct = list(dict.fromkeys(x for x in row if x is not None))
            out.append([p for p, c in zip(distinct, contained(distinct)) if not c])
        return pd.Series(out)

    return run(parts)
