"""Vectorised words: byte-level splitting and hashing of Arrow text columns.

Every class of characters used here is closed over UTF-8 bytes (all bytes of
a multi-byte character fall on the same side), so splitting bytes splits code
points.  Texts are taken in slices of about ``BLOCK`` bytes; a longer text is
a slice of its own, cut at separators, so memory follows the block and the
number of words, never the batch.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
#: words of more bytes are hashed one by one with BLAKE2b, others in blocks of eight bytes
LONG = 256

SPACES = b" \t\n\x0b\x0c\r"


def _table(excluded: bytes) -> np.ndarray:
    t = np.ones(256, bool)
    t[list(excluded)] = False
    return t


#: ``[^\x20\x09-\x0D]``: everything but six blanks.
NOT_SPACE = _table(SPACES)
#: runs between line feeds.
NOT_NEWLINE = _table(b"\n")
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing: digits, letters, non-ASCII.
ALNUM = _table(bytes(c for c in range(128) if not chr(c).isalnum()))
#: letters and non-ASCII.
ALPHA = _table(bytes(c for c in range(128) if not chr(c).isalpha()))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SAME = np.arange(256, dtype=np.uint8)

def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds)."""
    with np.errstate(over="ignore"):
        h = h + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def column(arr) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offs, data = arr.buffers()
    if len(arr) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), o


def slices(offs: np.ndarray, limit: int = BLOCK):
    """Row ranges of at most ``limit`` bytes; a longer text has its own."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


@dataclass
class Words:
    """Words of the rows lo..hi: row (from lo), byte offsets in the column, hash."""

    lo: int
    hi: int
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    #: with ``heads``: a column for each length, the hash of the word's first bytes (0: shorter)
    heads: np.ndarray | None = None

    @property
    def rows(self) -> int:
        return self.hi - self.lo

    def bounds(self) -> np.ndarray:
        """Index of each row's first word, and the number of words."""
        return np.searchsorted(self.row, np.arange(self.rows + 1))


def _edges(seg: np.ndarray, inner: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m = table[seg]
    s, e = m.copy(), m.copy()
    s[1:] &= ~m[:-1]
    e[:-1] &= ~m[1:]
    cut = inner[(inner > 0) & (inner < len(seg))]
    s[cut] = m[cut]
    e[cut - 1] = m[cut - 1]
    return np.flatnonzero(s), np.flatnonzero(e) + 1


def step(h: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Take one more 64-bit block into the states h."""
    with np.errstate(over="ignore"):
        h = (h ^ block) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(29))


def _loads(seg: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of seg (zeros past its end) as one number."""
    wide = np.zeros(len(seg) + 8, np.uint8)
    wide[: len(seg)] = seg
    return np.ndarray((len(seg) + 1,), "<u8", wide, strides=(1,))


def _block(v: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Blocks from ``at``, of which only the first ``left`` bytes count."""
    shift = (np.maximum(8 - left, 0) * 8).astype(np.uint64)
    return (v[at] << shift) >> shift


def _hash_piece(seg: np.ndarray, s: np.ndarray, e: np.ndarray, fold: np.ndarray, heads: tuple = ()) -> tuple[np.ndarray, np.ndarray]:
    """Of each word s..e: a hash of its length and its bytes in blocks of eight, each mixed in before the next; and of its heads."""
    size = e - s
    h = mix(size.astype(np.uint64), 3)
    out = np.zeros((len(s), len(heads)), np.uint64)
    if not len(s):
        return h, out
    seg = fold[seg]
    v = _loads(seg)
    live = np.arange(len(s))
    k = 0
    while len(live):
        h[live] = step(h[live], _block(v, s[live] + k, size[live] - k))
        k += 8
        live = live[(size[live] > k) & (size[live] <= LONG)]
    for i in np.flatnonzero(size > LONG):
        h[i] = int.from_bytes(hashlib.blake2b(seg[s[i] : e[i]].tobytes(), digest_size=8).digest(), "little")
    for k, n in enumerate(heads):
        ok = size >= n
        out[ok, k] = mix(step(np.full(int(ok.sum()), np.uint64(n)), _block(v, s[ok], np.full(int(ok.sum()), n))), 1)
    return mix(h), out


def same(data: np.ndarray, s: np.ndarray, e: np.ndarray, t: np.ndarray, u: np.ndarray, lower: bool = False) -> np.ndarray:
    """Whether the bytes s..e and t..u of data are equal, pair by pair: the check by content behind equal hashes."""
    fold = LOWER if lower else _SAME
    out = e - s == u - t
    for i in np.flatnonzero(out & (e - s > LONG)):
        out[i] = all(np.array_equal(fold[data[s[i] + k : min(s[i] + k + BLOCK, e[i])]], fold[data[t[i] + k : min(t[i] + k + BLOCK, u[i])]]) for k in range(0, int(e[i] - s[i]), BLOCK))
    live = np.flatnonzero(out & (e - s <= LONG))
    for k in range(LONG):
        live = live[(e[live] - s[live]) > k]
        if not len(live):
            break
        out[live] = fold[data[s[live] + k]] == fold[data[t[live] + k]]
        live = live[out[live]]
    return out


def scan(data: np.ndarray, offs: np.ndarray, lo: int, hi: int, table: np.ndarray = NOT_SPACE, lower: bool = False, hashed: bool = True, heads: tuple = ()) -> Words:
    """Words (maximal runs of bytes in ``table``) of the rows lo..hi."""
    fold = LOWER if lower else _SAME
    base, stop = int(offs[lo]), int(offs[hi])
    if stop - base <= 2 * BLOCK:
        seg = data[base:stop]
        s, e = _edges(seg, offs[lo : hi + 1] - base, table)
        h, first = _hash_piece(seg, s, e, fold, heads) if hashed else (np.zeros(0, np.uint64), None)
        row = np.searchsorted(offs[lo : hi + 1] - base, s, side="right") - 1
        return Words(lo, hi, row, s + base, e + base, h, first)
    assert hi == lo + 1
    ss, ee, hh, ff, pos = [], [], [], [], base
    none = np.zeros(0, np.int64)
    while pos < stop:
        end = min(pos + BLOCK, stop)
        if end < stop and table[data[end]]:
            out = np.flatnonzero(~table[data[pos:end]])
            if len(out):
                end = pos + int(out[-1]) + 1
            else:  # one word fills the block and goes on
                while end < stop and table[data[end]]:
                    more = np.flatnonzero(~table[data[end : end + BLOCK]])
                    end = end + int(more[0]) if len(more) else min(end + BLOCK, stop)
                ss.append(np.array([pos]))
                ee.append(np.array([end]))
                if hashed:
                    d = hashlib.blake2b(digest_size=8)
                    for k in range(pos, end, BLOCK):
                        d.update(fold[data[k : min(k + BLOCK, end)]].tobytes())
                    hh.append(mix(np.frombuffer(d.digest(), "<u8").astype(np.uint64)))
                    ff.append(_hash_piece(data[pos : pos + LONG], np.zeros(1, np.int64), np.full(1, LONG), fold, heads)[1])
                pos = end
                continue
        seg = data[pos:end]
        s, e = _edges(seg, none, table)
        ss.append(s + pos)
        ee.append(e + pos)
        if hashed:
            h, first = _hash_piece(seg, s, e, fold, heads)
            hh.append(h)
            ff.append(first)
        pos = end
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    s = cat(ss, np.int64)
    return Words(lo, hi, np.zeros(len(s), np.int64), s, cat(ee, np.int64), cat(hh, np.uint64), np.concatenate(ff) if ff else np.zeros((0, len(heads)), np.uint64))


def count(data: np.ndarray, offs: np.ndarray, lo: int, hi: int, table: np.ndarray) -> np.ndarray:
    """Bytes of each row that are in ``table``."""
    if hi == lo + 1:
        a, b = int(offs[lo]), int(offs[hi])
        return np.array([sum(int(np.count_nonzero(table[data[k : min(k + BLOCK, b)]])) for k in range(a, b, BLOCK))])
    base = int(offs[lo])
    c = np.concatenate([[0], np.cumsum(table[data[base : int(offs[hi])]])])
    return np.diff(c[offs[lo : hi + 1] - base])


def windows(w: Words, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word, and hash, of each run of n words within a row."""
    if len(w.row) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(w.row[n - 1 :] == w.row[: len(w.row) - n + 1])
    h = np.full(len(at), np.uint64(0x51ED270B + n))
    for k in range(n):
        h = step(h, w.hash[at + k])
    return at, mix(h, seed)


def normalised(data: np.ndarray, offs: np.ndarray, lo: int, hi: int, table: np.ndarray = NOT_SPACE) -> list[bytes]:
    """Of each row its lower-cased words, one blank between two; equal exactly where the words are."""
    base, stop = int(offs[lo]), int(offs[hi])
    if hi > lo + 1 or stop - base <= 2 * BLOCK:
        seg = data[base:stop]
        word = table[seg]
        keep = word.copy()
        keep[1:] |= word[:-1]
        kept = np.where(word, LOWER[seg], np.uint8(32))[keep]
        cut = np.concatenate([[0], np.cumsum(keep)])[offs[lo : hi + 1] - base]
        raw = kept.tobytes()
        # a blank right after a row's end belongs to the next row's start
        return [raw[a:z].strip(b" ") for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    out, before = [], False
    for a in range(base, stop, BLOCK):
        seg = data[a : min(a + BLOCK, stop)]
        word = table[seg]
        keep = word.copy()
        keep[1:] |= word[:-1]
        keep[0] |= before
        out.append(np.where(word, LOWER[seg], np.uint8(32))[keep].tobytes())
        before = bool(word[-1])
    return [b"".join(out).strip(b" ")]
