"""Cuts text into the matches of the byte-level BPE pattern without a regular expression.

The pattern is  's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Each code point becomes a symbol: its class, and for apostrophes and white space what
follows.  Each symbol is a function from automaton state to automaton state.  Composition
of such functions is associative, so the state before every code point comes from a
blocked prefix scan over function numbers: one table of products, no loop over the text.
"""

import unicodedata
from functools import lru_cache

import numpy as np

#: Code points with the Unicode property White_Space (fixed values of the standard).
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
LETTER, NUMBER, OTHER, SPACE, UNASSIGNED = 0, 1, 2, 3, 4

# symbols: the classes 0 to 2, then
SHORT, LONG, LEAD, TAIL, RUN = 3, 4, 5, 6, 7  # 's 't 'd 'm; 're 've 'll; a space or other white space before text; white space before white space or the end
FIRST = 8  # added at the first code point of a row

START, IN_LETTER, IN_NUMBER, IN_OTHER, AFTER_LEAD, IN_RUN, ONE_MORE, TWO_MORE = range(8)


def _step(state: int, symbol: int) -> tuple[int, int]:
    """The next state, and 1 if a token starts at this code point."""
    if symbol >= FIRST:
        state, symbol = START, symbol - FIRST
    if state == TWO_MORE:
        return ONE_MORE, 0
    if state == ONE_MORE:
        return START, 0
    as_other = symbol in (OTHER, SHORT, LONG)
    if state == AFTER_LEAD and symbol in (LETTER, NUMBER) or state == IN_LETTER and symbol == LETTER or state == IN_NUMBER and symbol == NUMBER:
        return (IN_LETTER, IN_NUMBER)[symbol], 0
    if state in (AFTER_LEAD, IN_OTHER) and as_other:
        return IN_OTHER, 0
    if state == IN_RUN and symbol == RUN:
        return IN_RUN, 0
    return (IN_LETTER, IN_NUMBER, IN_OTHER, ONE_MORE, TWO_MORE, AFTER_LEAD, START, IN_RUN)[symbol], 1


@lru_cache(1)
def _automaton():
    """Product table of the functions, their values, and the boundary of (state, symbol)."""
    symbols, states = range(2 * FIRST), range(8)
    functions = list(dict.fromkeys(tuple(_step(s, x)[0] for s in states) for x in symbols))
    functions.insert(0, tuple(states))  # number 0: the identity
    number = {f: i for i, f in enumerate(functions)}
    at = 0
    while at < len(functions):  # close under composition
        for g in functions[: at + 1]:
            for h in (tuple(functions[at][s] for s in g), tuple(g[s] for s in functions[at])):
                if h not in number:
                    number[h] = len(functions)
                    functions.append(h)
        at += 1
    size = len(functions)
    product = np.array([number[tuple(g[s] for s in f)] for f in functions for g in functions], np.uint8 if size <= 256 else np.uint16)
    value = np.array(functions, np.uint8)
    of_symbol = np.array([number[tuple(_step(s, x)[0] for s in states)] for x in symbols], product.dtype)
    starts = np.array([[_step(s, x)[1] for x in symbols] for s in states], bool)
    return product, size, value, of_symbol, starts


def _before(numbers: np.ndarray, product: np.ndarray, size: int, block: int = 64) -> np.ndarray:
    """For each position the product of all functions before it (exclusive scan)."""
    n = len(numbers)
    if n <= block:
        out, acc = np.zeros(n, product.dtype), 0
        for i, f in enumerate(numbers.tolist()):
            out[i] = acc
            acc = product[acc * size + f]
        return out
    rows = -(-n // block)
    grid = np.zeros((rows, block), product.dtype)
    grid.reshape(-1)[:n] = numbers
    grid = np.ascontiguousarray(grid.T)
    within = np.zeros((block, rows), product.dtype)  # exclusive products inside each block
    acc = np.zeros(rows, product.dtype)
    for j in range(block):
        within[j] = acc
        acc = product.take(acc.astype(np.intp) * size + grid[j])
    carried = _before(acc, product, size, block)
    out = product.take(carried.astype(np.intp)[None, :] * size + within)
    return np.ascontiguousarray(out.T).reshape(-1)[:n]


@lru_cache(1)
def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    category = unicodedata.category
    for c in range(0x110000):
        k = category(chr(c))
        if k[0] == "L":
            table[c] = LETTER
        elif k[0] == "N":
            table[c] = NUMBER
        elif k == "Cn":
            table[c] = UNASSIGNED
    table[list(WHITE_SPACE)] = SPACE
    return table


@lru_cache(1)
def _library_cutter():
    from tokenizers import pre_tokenizers

    return pre_tokenizers.ByteLevel(add_prefix_space=False)


def _settle(table: np.ndarray, points: np.ndarray) -> None:
    """Classes of code points that this Python's Unicode tables do not know: as the tokenizers library cuts them."""
    for c in np.unique(points).tolist():
        cuts = {a for _, (a, _) in _library_cutter().pre_tokenize_str(f"a{chr(c)}a1{chr(c)}1")}
        table[c] = LETTER if 1 not in cuts else NUMBER if 4 not in cuts else OTHER


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8 bytes, and the byte position of each."""
    if not len(data) or data.max() < 0x80:
        return data.astype(np.uint32), np.arange(len(data))
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at]
    points = lead.astype(np.uint32)
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    for least, most, bits, more in ((0xC0, 0xDF, 0x1F, 1), (0xE0, 0xEF, 0x0F, 2), (0xF0, 0xFF, 0x07, 3)):
        own = np.flatnonzero((lead >= least) & (lead <= most))
        if len(own):
            value = lead[own].astype(np.uint32) & bits
            for j in range(1, more + 1):
                value = (value << 6) | (padded[at[own] + j] & 0x3F)
            points[own] = value
    return points, at


def token_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which a match of the pattern starts, over rows laid end to end."""
    if not len(data):
        return np.zeros(0, np.int64)
    product, size, value, of_symbol, starts = _automaton()
    points, at = code_points(data)
    n, table = len(points), _classes()
    kind = table.take(points)
    if (unknown := kind == UNASSIGNED).any():
        _settle(table, points[unknown])
        kind = table.take(points)
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(at, offsets)] = True  # rows' first code points, and the end
    follows = np.ones(n + 3, np.uint32)
    follows[:n] = points
    last = first[1:]
    symbol = kind.copy()
    quote = np.flatnonzero((points == 0x27) & ~last)
    if len(quote):
        one, two = follows[quote + 1], follows[quote + 2]
        symbol[quote[np.isin(one, (0x73, 0x74, 0x64, 0x6D))]] = SHORT  # s t d m
        pair = ~last[np.minimum(quote + 1, n - 1)] & (((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C))  # re ve ll
        symbol[quote[pair]] = LONG
    space = np.flatnonzero(kind == SPACE)
    inner = last[space] | (kind[np.minimum(space + 1, n - 1)] == SPACE)
    symbol[space] = np.where(inner, RUN, np.where(points[space] == 0x20, LEAD, TAIL))
    symbol += FIRST * first[:n].astype(np.uint8)
    state = value[:, START].take(_before(of_symbol.take(symbol), product, size))
    return at[starts[state, symbol]]


class SliceCache:
    """ids of slices, remembered up to `most` slices: encode_many(list of bytes) gives the
    number of ids of each slice and all ids laid end to end."""

    def __init__(self, encode_many, most: int = 400_000):
        self.encode_many, self.most = encode_many, most
        self._clear()

    def _clear(self):
        self.slot: dict[bytes, int] = {}
        self.begin, self.length, self.ids, self.used = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), np.zeros(1 << 14, np.uint32), 0

    def _add(self, keys: list[bytes]) -> None:
        lengths, flat = self.encode_many(keys)
        at = len(self.slot)
        self.slot.update(zip(keys, range(at, at + len(keys))))
        while at + len(keys) > len(self.begin):
            self.begin, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.length))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.begin[at : at + len(keys)] = self.used + np.cumsum(lengths) - lengths
        self.length[at : at + len(keys)] = lengths
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def encode(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all slices laid end to end, and the number of ids of each slice."""
        if len(self.slot) > self.most:
            self._clear()
        found = list(map(self.slot.get, keys))
        if None in found:
            self._add(list(dict.fromkeys(k for k, slot in zip(keys, found) if slot is None)))
            found = list(map(self.slot.__getitem__, keys))
        slots = np.array(found, np.int64)
        lengths = self.length[slots].astype(np.int64)
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.begin[slots] - ends + lengths, lengths) + np.arange(total)], lengths


def encode_rows(data: np.ndarray, offsets: np.ndarray, cache: SliceCache):
    """(ids, id offsets of rows, byte offset of each id's slice, ids per slice) of rows laid end to end."""
    starts = token_starts(data, offsets)
    raw = data.tobytes()
    edges = [*starts.tolist(), len(raw)]
    ids, lengths = cache.encode([raw[a:b] for a, b in zip(edges, edges[1:])])
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return ids, ends[np.searchsorted(starts, offsets)], starts, lengths
