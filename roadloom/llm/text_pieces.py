"""Texts cut into the pieces of a byte-level BPE, and coded piece by piece, many texts at a time in numpy.

The cuts are those of the pattern `public_tokenizers.PATTERN`: a run of
letters, digits or other characters with the space before it, contractions,
white space. Bytes are cut at single spaces and line ends between characters
that are surely no white space; a unit between cuts of nothing but letters,
digits and ASCII marks is cut further where these kinds meet. Any other unit
(an apostrophe, more white space, letters beyond the tables here) goes to the
pattern itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from roadloom.llm.word_hash import MASKS, mix

_U = np.uint64
LETTER, DIGIT, MARK, SPACE, LINE, OTHER, LEAD = range(7)
#: Two-byte sequences of letters only begin with these bytes, but for the two signs in `_SIGNS` after 0xC3.
_LEADS, _SIGNS = (0xC3, 0xC4, 0xC5, 0xD0, 0xD1), (0x97, 0xB7)
_KIND = np.full(256, OTHER, np.uint8)
for _b in range(33, 127):
    _KIND[_b] = LETTER if chr(_b).isalpha() else DIGIT if chr(_b).isdigit() else MARK
_KIND[ord("'")], _KIND[ord(" ")], _KIND[ord("\n")] = OTHER, SPACE, LINE
_KIND[list(_LEADS)] = LEAD
_PAD = bytes(16)
_SAFE = re.compile(rb"(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")


def cut(raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, simple) of the pieces of UTF-8 texts that lie one after the other and begin at `begins`; a piece that is not simple is a unit for the pattern."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    kind = _KIND[raw]
    lead = np.flatnonzero(kind == LEAD)
    if len(lead):
        after = raw[np.minimum(lead + 1, n - 1)]
        sign = (raw[lead] == 0xC3) & ((after == _SIGNS[0]) | (after == _SIGNS[1]))
        kind[lead] = np.where(sign, OTHER, LETTER)
        kind[lead[~sign] + 1] = LETTER
    solid = kind <= MARK
    solid |= raw == ord("'")
    between = np.zeros(n, bool)
    between[1:-1] = solid[:-2] & solid[2:]
    line = np.flatnonzero((kind == LINE) & between)
    new = (kind == SPACE) & between
    new[line] = True
    new[line + 1] = True
    new[begins[begins < n]] = True
    new[0] = True
    units = np.flatnonzero(new)
    bad = np.add.reduceat((kind > MARK).astype(np.int64), units)
    size = np.diff(units, append=n)
    pure = bad - ((kind[units] == SPACE) | (kind[units] == LINE) & (size == 1)) == 0
    inner = np.zeros(n, bool)
    inner[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != SPACE)
    inner &= np.repeat(pure, size)
    starts = np.flatnonzero(new | inner)
    return starts, np.append(starts[1:], n), np.repeat(pure, np.diff(np.searchsorted(starts, units), append=len(starts)))


def long_text_parts(raw: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(start, end) of parts of one text of `most` bytes or a little more, cut where a piece ends."""
    data, at = memoryview(raw), 0
    while len(raw) - at > most:
        found = _SAFE.search(data, at + most)
        if not found:
            break
        yield at, found.start()
        at = found.start()
    yield at, len(raw)


class PieceCoder:
    """Ids of texts, from a function that gives a piece's.

    The ids of pieces are kept, as words recur, until `keep` are held; then
    all are dropped. Pieces of 16 bytes or fewer are looked up by hash and
    compared byte by byte.
    """

    def __init__(self, of_piece: Callable[[str], list[int]], find: Callable[[str], list[str]], keep: int = 600_000):
        self.of_piece, self.find, self.keep = of_piece, find, keep
        self.clear()

    def clear(self) -> None:
        self.known = [np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)]  # hash, bytes 0-7, bytes 8-15, size, start, ids
        self.rest: dict[bytes, tuple[int, int]] = {}
        self.blob, self.used = np.zeros(1 << 16, "<u4"), 0

    def _stored(self, ids: list[int]) -> tuple[int, int]:
        at, n = self.used, len(ids)
        if at + n > len(self.blob):
            self.blob = np.concatenate([self.blob, np.zeros(max(n, len(self.blob)), "<u4")])
        self.blob[at : at + n] = ids
        self.used += n
        return at, n

    def coded(self, raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each text) of texts that lie one after the other in `raw` and begin at `begins`."""
        if len(self.known[0]) + len(self.rest) > self.keep:
            self.clear()
        starts, ends, simple = cut(raw, begins)
        size = ends - starts
        padded = np.concatenate([raw, np.frombuffer(_PAD, np.uint8)])
        blocks = np.ndarray(len(raw) + 9, "<u8", padded, strides=(1,))
        low, high = blocks[starts] & MASKS[np.minimum(size, 8)], blocks[starts + 8] & MASKS[np.clip(size - 8, 0, 8)]
        place, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        at = np.flatnonzero(simple & (size <= 16))
        key, first, of = np.unique(mix(mix(mix(size[at].astype(_U)) ^ low[at]) ^ high[at]), return_index=True, return_inverse=True)
        first = at[first]
        keys, k_low, k_high, k_size, k_start, k_ids = self.known
        where = np.searchsorted(keys, key)
        near = np.minimum(where, max(0, len(keys) - 1))
        taken = keys[near] == key if len(keys) else np.zeros(len(key), bool)
        text = raw.tobytes()
        if (~taken).any():
            lost = np.flatnonzero(~taken)
            got = [self._stored(self.of_piece(text[a:b].decode())) for a, b in zip(starts[first[lost]].tolist(), ends[first[lost]].tolist(), strict=True)]
            new = np.array(got, np.int64).reshape(len(lost), 2)
            rep = first[lost]
            self.known = [np.insert(x, where[lost], y) for x, y in zip(self.known, (key[lost], low[rep], high[rep], size[rep], new[:, 0], new[:, 1]), strict=True)]
            keys, k_low, k_high, k_size, k_start, k_ids = self.known
            near = np.searchsorted(keys, key)
        if len(at):
            slot = near[of]
            place[at], count[at] = k_start[slot], k_ids[slot]
            same = (k_low[slot] == low[at]) & (k_high[slot] == high[at]) & (k_size[slot] == size[at])
            simple[at[~same]] = False  # another piece has that hash
        for i in np.flatnonzero(~simple | (size > 16)).tolist():
            unit = text[starts[i] : ends[i]]
            found = self.rest.get(unit)
            if found is None:
                found = self._stored([k for p in self.find(unit.decode("utf-8", "surrogatepass")) for k in self.of_piece(p)])
                if len(unit) <= 256:
                    self.rest[unit] = found
            place[i], count[i] = found
        total = np.concatenate([[0], np.cumsum(count)])
        index = np.repeat(place - total[:-1], count)
        index += np.arange(total[-1])
        return self.blob[index], np.diff(total[np.searchsorted(starts, np.append(begins, len(raw)))])

    def column(self, texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(index of the first, ids, number of each) of runs of texts of about `most` bytes; nulls are empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
            raw = data[offsets[i] : offsets[j]]
            if len(raw) > most:
                parts = [self.coded(raw[a:b], np.zeros(1, np.int64))[0] for a, b in long_text_parts(raw, most)]
                ids = np.concatenate(parts)
                yield i, ids, np.array([len(ids)])
            else:
                yield (i, *self.coded(raw, offsets[i:j] - offsets[i]))
            i = j
