"""64-bit hashes of words and shingles for many texts at a time, in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

_U = np.uint64
#: A-Z lower-cased, nothing else; bytes.split() cuts at the six ASCII white-space characters.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.array([b in (9, 10, 11, 12, 13, 32) for b in range(256)])
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64), other for each seed."""
    with np.errstate(over="ignore"):
        x = x + _U((seed + 1) * _BASE & (1 << 64) - 1)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


#: Words of more bytes are hashed one by one by blake2b.
_MOST = 256
#: The lowest 0 to 8 bytes of a block.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)


def encode(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(LOWER) if text else b""


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of bytes other than white space) of the texts, in order, and the number in each text.

    A word's blocks of eight bytes go through `mix` one after the other, begun
    with its length, so words of eight bytes or fewer never collide among
    their length and no rule of spelling makes longer ones collide; two given
    words do so with a chance of about 2^-64.
    """
    joined = np.frombuffer(b" ".join([*texts, bytes(8)]), np.uint8)
    word = ~_SPACE[joined]
    word[-8:] = False
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])
    counts = np.diff(np.searchsorted(starts, offsets))
    blocks = np.ndarray(len(joined) - 7, "<u8", joined, strides=(1,))
    size = ends - starts
    found = mix(mix(size.astype(_U), 3) ^ blocks[starts] & MASKS[np.minimum(size, 8)], 4)
    at = np.flatnonzero(size > 8)
    for done in range(8, _MOST, 8):
        if not len(at):
            break
        rest = size[at] - done
        found[at] = mix(found[at] ^ blocks[starts[at] + done] & MASKS[np.minimum(rest, 8)], 4)
        at = at[rest > 8]
    for i in np.flatnonzero(size > _MOST).tolist():
        found[i] = int.from_bytes(hashlib.blake2b(joined[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return found, counts


def chunks(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, encoded texts) of runs of texts with about `most` bytes, at least one text each."""
    held, size, first = [], 0, 0
    for i, t in enumerate(texts):
        b = encode(t)
        if held and size + len(b) > most:
            yield first, held
            held, size, first = [], 0, i
        held.append(b)
        size += len(b)
    if held:
        yield first, held


#: Odd multipliers of a shingle's words, in order.
_ODD = mix(np.arange(64, dtype=_U), 7) | _U(1)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` words (64 at most); of all words where there are fewer; none without words."""
    n = len(words)
    if not n:
        return words
    here = min(width, n)
    with np.errstate(over="ignore"):
        total = words[: n - here + 1] * _ODD[0]
        for j in range(1, here):
            total += words[j : n - here + 1 + j] * _ODD[j]
    return mix(total, 1000 + here)


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values."""
    x = np.sort(x)
    if len(x) < 2:
        return x
    keep = np.empty(len(x), bool)
    keep[0] = True
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def set_chunks(texts: list[str | None], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first, sorted distinct shingle hashes of each text one after the other, their numbers) of runs of texts."""
    for first, held in chunks(texts):
        words, counts = word_hashes(held)
        over = shingles(words, width)  # of all texts; those that cross from one to the next are not looked at
        ends = np.cumsum(counts)
        sets = [distinct(over[a : b - width + 1] if b - a >= width else shingles(words[a:b], width)) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
        yield first, np.concatenate(sets), np.array([len(x) for x in sets])


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, flat, counts in set_chunks(texts, width):
        yield from np.split(flat, np.cumsum(counts)[:-1])
