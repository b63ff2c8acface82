"""Periodic run detection (operator 11): multi-scale minimizers.

A run is a stretch of words with smallest period q, of max(LEAST, 2 q) words or more, that no
neighbouring word extends with that period.  All runs of each whole text are found:

* Lags below LAGS are scanned directly: stretches in which words a lag apart are equal.
* Periods from W to 2 W - 1, for W = LAGS, 2 LAGS, 4 LAGS, ...: each window of W words picks the least hash of
  its slices of K = W / 2 words.  In a run the window one period on holds the same words and picks the slice one
  period on, so two equal minimizers that far apart are the seed of its extension to both sides.

Slices that have a period of K / 2 or less themselves are never picked: they lie in runs that
smaller scales have found.  Without them equal slices are more than K / 2 apart, so a minimizer meets a few equal ones within
2 W words, never all of a group.  Every window of a run has another slice to pick, but where its whole root has
such a short period p.  Then the run spans two neighbouring runs of period p, one for each of its halves; words of those
agree at lags of one remainder modulo p only, and these lags are seeds too, each of which is a run.

Seeds are extended by binary search on hashes of prefixes; every run is then compared word by word, and
where hashes deceived, scanned at its lag.  Of runs with one stretch the smallest period stays.

Work is about n log n for a text of n words, in arrays of about 60 bytes a word; texts are taken whole, short ones
about a megabyte at a time.  Null and empty texts have no run.  Rows are independent: repeated rows, ties and extra columns
(kept, but those named like the new ones are replaced) do not matter.
"""

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .bpe import _append as with_columns
from .columns import row_chunks, text_buffer
from .textkernel import mix

LEAST, LAGS = 12, 32  #: words that a run has at least; lags below are scanned (a power of two, twice LEAST or more)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORST = np.uint64(0xFFFFFFFFFFFFFFFF)
NO_RUNS = np.zeros((0, 3), np.int64)  #: columns: first word, last word, period


def stretches(ids: np.ndarray, ends: np.ndarray, lag: int) -> np.ndarray:
    """Stretches of max(LEAST, 2 lag) words or more whose words a lag apart are equal; ends: the end of each word's row."""
    at = np.flatnonzero(ids[:-lag] == ids[lag:]) if lag < len(ids) else np.zeros(0, np.int64)
    at = at[at + lag < ends[at]]
    if not len(at):
        return NO_RUNS
    cut = np.flatnonzero(np.diff(at) != 1)
    first, last = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])] + lag
    long = last - first + 1 >= max(LEAST, 2 * lag)
    return np.stack([first[long], last[long], np.full(int(long.sum()), lag)], 1)


class Prefixes:
    """Hashes of all stretches of a sequence, and how far two places agree."""

    def __init__(self, values: np.ndarray):
        self.powers = np.full(len(values) + 1, _BASE, np.uint64)
        self.powers[0] = 1
        np.cumprod(self.powers, out=self.powers)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.powers[:-1], out=self.sums[1:])

    def same(self, a: np.ndarray, lag: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.sums[a + n] - self.sums[a]) * self.powers[lag] == self.sums[a + lag + n] - self.sums[a + lag]

    def extended(self, at: np.ndarray, lag: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last word of the stretch of period `lag` at words `at` of rows from begin to end."""
        ahead = self._most(end - at - lag, lambda n: self.same(at, lag, n))
        back = self._most(at - begin, lambda n: self.same(at - n, lag, n))
        return at - back, at + lag + ahead - 1

    @staticmethod
    def _most(limit: np.ndarray, fits) -> np.ndarray:
        low, high = np.zeros_like(limit), limit.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            good = fits(middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return low


def over_windows(best, values: np.ndarray, width: int) -> np.ndarray:
    """best of values[i : i + width] for each i; width is a power of two and one."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = best(out[:-step], out[step:])
        have += step
    return out


def minimizers(slices: np.ndarray, barred: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and keys of the slices of width / 2 words that are the least of a window of `width` words; barred ones never are."""
    keys = mix(slices ^ np.uint64(width))
    keys[barred] = _WORST
    least = over_windows(np.minimum, keys, width // 2 + 1)
    least[np.arange(len(keys)) + width > ends] = 0  # no window starts here
    behind = over_windows(np.maximum, least[::-1], width // 2 + 1)[::-1]
    at = np.flatnonzero((behind == keys) & (keys != _WORST))
    return at, keys[at]


def equal_pairs(at: np.ndarray, keys: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of minimizers of one row with equal keys, width to 2 width - 1 words apart."""
    order = np.argsort(keys, kind="stable")
    at, keys, found = at[order], keys[order], []
    for gap in range(1, len(at)):
        lag = at[gap:] - at[:-gap]
        near = (keys[gap:] == keys[:-gap]) & (lag < 2 * width)
        if not near.any():
            break
        near &= (lag >= width) & (ends[at[:-gap]] == ends[at[gap:]])
        found.append((at[:-gap][near], lag[near]))
    return tuple(map(np.concatenate, zip(*found))) if found else (np.zeros(0, np.int64),) * 2


def rotation(a: np.ndarray, b: np.ndarray) -> int:
    """o with b[j] == a[(j + o) % p] for all j, or -1."""
    twice, wanted, size = np.concatenate([a, a]).tobytes(), b.tobytes(), a.itemsize
    at = twice.find(wanted)
    while at >= 0 and at % size:
        at = twice.find(wanted, at + 1)
    return at // size if at >= 0 else -1


def between_runs(ids: np.ndarray, ends: np.ndarray, known: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of seeds that span two neighbouring runs of one short period, for lags of width to 2 width - 1."""
    runs = known[(known[:, 2] <= width // 4) & (known[:, 1] - known[:, 0] + 1 >= width)]
    runs = runs[np.lexsort((runs[:, 0], runs[:, 2], ends[runs[:, 0]]))]
    left, right = runs[:-1], runs[1:]
    meet = (left[:, 2] == right[:, 2]) & (ends[left[:, 0]] == ends[right[:, 0]]) & (right[:, 0] <= left[:, 1] + 1)
    places, lags = [], []
    for (a1, b1, p), (a2, b2, _) in zip(left[meet].tolist(), right[meet].tolist()):
        turn = rotation(ids[a1 : a1 + p], ids[a2 : a2 + p])
        if turn < 0:
            continue
        least = width + (a2 - a1 - turn - width) % p
        lag = np.arange(least, min(2 * width, b1 - a1 + 2, b2 - a2 + 2), p)
        first, last = np.maximum(a1, a2 - lag), np.minimum(b1, b2 - lag)
        good = last - first + 1 >= lag
        places.append(first[good])
        lags.append(lag[good])
    return (np.concatenate(places), np.concatenate(lags)) if places else (np.zeros(0, np.int64),) * 2


def smallest(found: np.ndarray) -> np.ndarray:
    """One run for each stretch: that of the smallest period; by start, then period."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    found = found[new]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def runs_of(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows (first word, last word, period) of all runs; ids: numbers of the words of rows laid end to end, offsets: n + 1 of the rows."""
    sizes = np.diff(offsets)
    begins, ends = np.repeat(offsets[:-1], sizes), np.repeat(offsets[1:], sizes)
    known = smallest(np.concatenate([NO_RUNS, *(stretches(ids, ends, lag) for lag in range(1, LAGS))]))
    width, most = LAGS, int(sizes.max(initial=0))
    if most < 2 * width:
        return known
    values = mix(ids.astype(np.uint64) + np.uint64(1))
    prefixes, slices, have, power = Prefixes(values), values, 1, np.full(1, _BASE, np.uint64)
    where = np.arange(len(ids))  # places of the rows that are long enough still
    while most >= 2 * width:
        while have < width // 2:
            slices = slices.copy()
            slices[:-have] = slices[:-have] * power + slices[have:]
            have, power = 2 * have, power * power
        left = np.flatnonzero(ends[where] - begins[where] >= 2 * width)
        if len(left) < len(where):
            where, slices = where[left], slices[left]
        own_ends = np.searchsorted(where, ends[where])  # rows are kept whole
        edge = np.zeros(len(where) + 1, np.int64)
        short = known[(known[:, 2] <= have // 2) & (known[:, 1] - known[:, 0] + 1 >= have) & (ends[known[:, 0]] - begins[known[:, 0]] >= 2 * width)]
        np.add.at(edge, np.searchsorted(where, short[:, 0]), 1)
        np.add.at(edge, np.searchsorted(where, short[:, 1] - have + 1) + 1, -1)
        barred = (np.cumsum(edge[:-1]) > 0) | (np.arange(len(where)) + have > own_ends)
        at, lag = equal_pairs(*minimizers(slices, barred, own_ends, width), own_ends, width)
        more = between_runs(ids, ends, known, width)
        at, lag = np.concatenate([where[at], more[0]]), np.concatenate([lag, more[1]])
        known = smallest(np.concatenate([known, extended(ids, prefixes, begins, ends, at, lag)]))
        width *= 2
    return known


def extended(ids: np.ndarray, prefixes: Prefixes, begins: np.ndarray, ends: np.ndarray, at: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """The runs of the seeds (place, lag), compared word by word."""
    first, last = prefixes.extended(at, lag, begins[at], ends[at])
    long = last - first + 1 >= 2 * lag
    found, seed = np.unique(np.stack([first, last, lag], 1)[long], axis=0, return_index=True)
    out = []
    for (a, b, q), m in zip(found.tolist(), at[long][seed].tolist()):
        if np.array_equal(ids[a : b - q + 1], ids[a + q : b + 1]):
            out.append((a, b, q))
            continue
        low, high = int(begins[m]), int(ends[m])  # hashes deceived: scan this lag
        own = stretches(ids[low:high], np.full(high - low, high - low), q)
        out += [(low + x, low + y, q) for x, y, _ in own.tolist()]
    return np.array(out, np.int64).reshape(-1, 3)


def numbered(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words of all texts end to end, a number for each distinct word, and the texts' offsets."""
    own = [x.split() for x in texts]  # of bytes: at 0x20 and 0x09 to 0x0D
    words = [w for x in own for w in x]
    slot: dict[bytes, int] = {}
    ids = np.fromiter((slot.setdefault(w, len(slot)) for w in words), np.int32, len(words))
    return words, ids, np.concatenate([[0], np.cumsum([len(x) for x in own], dtype=np.int64)])


RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())])


def find(df: DataFrame, text: str = "text") -> DataFrame:
    """df without the text, with `n_words`, `runs` (array of struct<start, length, period>, word numbers, by start and period)
    and `collapsed`: the words joined by one space without those that a run holds after its first period."""
    new = [("n_words", T.LongType()), ("runs", T.ArrayType(RUN)), ("collapsed", T.StringType())]

    def make(batch):
        data, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
        sizes, counts, parts, collapsed = [], [], [NO_RUNS], []
        for a, b in row_chunks(offsets):
            raw, own = data[offsets[a] : offsets[b]].tobytes(), (offsets[a : b + 1] - offsets[a]).tolist()
            words, ids, rows = numbered([raw[x:y] for x, y in zip(own, own[1:])])
            found = runs_of(ids, rows)
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, found[:, 0] + found[:, 2], 1)
            np.add.at(edge, found[:, 1] + 1, -1)
            kept = np.cumsum(edge[:-1]) == 0
            of = np.searchsorted(rows, found[:, 0], "right") - 1
            of = of if len(rows) > 1 else np.zeros(0, np.int64)
            parts.append(np.stack([found[:, 0] - rows[of], found[:, 1] - found[:, 0] + 1, found[:, 2]], 1))
            counts.append(np.bincount(of, minlength=b - a))
            sizes.append(np.diff(rows))
            for x, y in zip(rows.tolist(), rows[1:].tolist()):
                all_kept = kept[x:y].all()
                collapsed.append(b" ".join(words[x:y] if all_kept else compress(words[x:y], kept[x:y].tolist())))
        flat = np.concatenate(parts)
        stops = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *counts]))]).astype(np.int32)
        runs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], RUN.names)
        return [pa.array(np.concatenate([np.zeros(0, np.int64), *sizes])), pa.ListArray.from_arrays(pa.array(stops), runs), pa.array(collapsed, pa.string())]

    return with_columns(df, new, (text,), make)
