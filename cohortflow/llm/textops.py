"""Vectorised byte-level text helpers that run inside Spark tasks (numpy only).

Texts are handled as UTF-8 bytes.  Work goes through blocks of about
``BLOCK`` bytes, so that memory per task stays bounded whatever the length of
a single text: a text longer than a block is cut where no word is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

BLOCK = 1 << 18

#: Modular polynomial hash: two primes below 2**31 and their bases.
_P = (np.uint64(2147483647), np.uint64(2147483629))
_R = (1_000_003, 69_069_071)
_U = np.uint64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = _LOWER.astype(np.uint64) + _U(1)

#: Words are what white space leaves (op 4): everything but \x20 and \x09-\x0D.
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII letters and digits and every byte of a non-ASCII character (op 8).
ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x41:0x5B] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x80:] = True

_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power(which: int, n: int) -> np.ndarray:
    """The first n powers of a base, kept and lengthened on demand."""
    have = _powers[which]
    if len(have) < n:
        out = np.empty(max(n, 2 * len(have), 256), dtype=np.uint64)
        x, r, p = 1, _R[which], int(_P[which])
        for i in range(len(out)):
            out[i] = x
            x = x * r % p
        _powers[which] = have = out
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _pieces(texts: Iterable[bytes], table: np.ndarray) -> Iterator[list[tuple[int, bytes, int]]]:
    """Groups of (text number, bytes, offset in the text) of about BLOCK bytes.
    Only a text longer than BLOCK is cut, each time before a byte of no word."""
    group, size = [], 0
    for i, raw in enumerate(texts):
        at, n = 0, len(raw)
        while n - at > 2 * BLOCK:
            cut = at + BLOCK
            while cut < n and table[raw[cut]]:
                cut += 1
            if cut >= n:
                break
            if group:
                yield group
                group, size = [], 0
            yield [(i, raw[at:cut], at)]
            at = cut
        group.append((i, raw[at:] if at else raw, at))
        size += n - at
        if size >= BLOCK:
            yield group
            group, size = [], 0
    if group:
        yield group


def word_hashes(texts: list[bytes], table: np.ndarray, spans: bool = False):
    """Per text the 64-bit hashes of its words (A-Z lower-cased); with
    ``spans`` also their start and end bytes.  Two words share a hash only
    when two independent 31-bit polynomial hashes agree."""
    out: list[list] = [[] for _ in texts]
    for group in _pieces(texts, table):
        raw = np.frombuffer(b"".join(x[1] for x in group), dtype=np.uint8)
        sizes = np.array([len(x[1]) for x in group], dtype=np.int64)
        if not len(raw):
            continue
        offs = np.concatenate(([0], np.cumsum(sizes)))
        inside = table[raw]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        heads = offs[:-1][sizes > 0]
        first[heads] = inside[heads]
        starts = np.flatnonzero(first)
        if not len(starts):
            continue
        where = np.flatnonzero(inside)
        at = np.searchsorted(where, starts)
        lens = np.diff(np.append(at, len(where)))
        pos = np.arange(len(where)) - np.repeat(at, lens)
        val = _VALUE[raw[where]]
        longest = int(lens.max())
        h1 = np.add.reduceat(val * _power(0, longest)[pos], at) % _P[0]
        h2 = np.add.reduceat(val * _power(1, longest)[pos], at) % _P[1]
        h = mix((h1 << _U(31)) | h2)
        cut = np.searchsorted(starts, offs)
        for k, (i, _, base) in enumerate(group):
            a, b = cut[k], cut[k + 1]
            if b > a:
                s = starts[a:b] - offs[k] + base
                out[i].append((h[a:b], s, s + lens[a:b]) if spans else (h[a:b],))
    none = (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))[: 3 if spans else 1]
    joined = [tuple(np.concatenate(c) for c in zip(*x)) if len(x) > 1 else x[0] if x else none for x in out]
    return joined if spans else [x[0] for x in joined]


_ODD = mix(np.arange(1, 65, dtype=np.uint64)) | _U(1)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct k-word shingle hashes, sorted; a shorter text is one shingle."""
    n = len(words)
    if not n:
        return words
    k, tag = min(k, n), min(k, n)
    with np.errstate(over="ignore"):
        s = np.full(n - k + 1, _U(tag))
        for j in range(k):
            s = s * _ODD[0] + words[j : n - k + 1 + j] * _ODD[j % 64]
    return np.unique(mix(s))


def utf8(column) -> list[bytes]:
    """Bytes of the texts of a pandas column or an Arrow array; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    arr = column if isinstance(column, (pa.Array, pa.ChunkedArray)) else pa.Array.from_pandas(column, type=pa.large_string())
    return [x or b"" for x in pc.cast(arr, pa.large_binary()).to_pylist()]


def slices(batches: Iterable, rows: int = 256) -> Iterator:
    """Smaller runs of rows of the batches that Spark hands over, so that what a task derives from texts stays small."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.iloc[at : at + rows]


def _slide(h: np.ndarray, w: int, f) -> np.ndarray:
    """f over each run of w neighbours (output i: h[i:i+w]), by doubling."""
    out, done = h, 1
    while done < w:
        step = min(done, w - done)
        out = f(out[: len(out) - step], out[step:])
        done += step
    return out


def anchors(raw: np.ndarray, offs: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the q-grams that are least in some
    ``length``-byte window of their text.  Equal windows hold the same least
    q-gram at the same place, so every window holds an anchor that all its
    copies share.  ``q`` is a multiple of 8; ``offs`` bounds the texts."""
    n, w = len(raw), length - q + 1
    if n < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    pad = np.concatenate((raw, np.zeros(8, np.uint8)))
    eight = np.empty(n, dtype=np.uint64)
    for j in range(8):
        m = (n - j + 7) // 8
        eight[j::8] = np.frombuffer(pad[j : j + 8 * m].tobytes(), dtype=np.uint64)
    full = n - q + 1
    h = eight[:full]
    with np.errstate(over="ignore"):
        for j in range(8, q, 8):
            h = (h ^ (h >> _U(29))) * _U(0x9E3779B97F4A7C15) + eight[j : j + full]
    h = mix(h) >> _U(1)
    ends = offs[1:]
    most = _U(0xFFFFFFFFFFFFFFFF)
    for e, s in zip(ends, offs[:-1]):
        h[max(s, e - q + 1) : e] = most
    least = _slide(h, w, np.minimum)  # one for each window start
    for e, s in zip(ends, offs[:-1]):
        least[max(s, e - length + 1) : e] = _U(0)
    pad2 = np.concatenate((np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)))
    top = _slide(pad2, w, np.maximum)[:full]
    pos = np.flatnonzero((h == top) & (h != most))
    return pos, h[pos]
