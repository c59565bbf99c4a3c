"""Vectorised word and shingle codes over Arrow text buffers.

Words are hashed from their bytes to 64 bits. Two states of 64 bits take in each lane of 8 bytes in different ways and are joined at the end: a lane that makes up for an earlier
one in one state doesn't in the other. A shingle's code mixes its words' hashes in order. No code is a plain polynomial, which self-similar strings could make equal; different shingles share a code with a chance of 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from folioscan.llm.common import U64, mix64

#: Bytes coded at once; a longer text is cut at white space, so that memory stays bounded.
CHUNK = 1 << 20
#: Bytes of a word that are hashed in lanes of 8 for all words together; longer ones are hashed one by one.
LANES = 256
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=U64)


def hashes(buf: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each range at:to of buf."""
    lanes = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))
    n = to - at
    lane = lanes[at] & _MASK[np.minimum(n, 8)]
    h = mix64((mix64(n.astype(U64) * U64(0xA0761D6478BD642F))) ^ lane)
    other = (lane + n.astype(U64)) * U64(0x9E3779B97F4A7C15)
    rows = np.flatnonzero((n > 8) & (n <= LANES))
    for first in range(8, LANES, 8):
        if not len(rows):
            break
        lane = lanes[at[rows] + first] & _MASK[np.minimum(n[rows] - first, 8)]
        h[rows] = mix64(h[rows] ^ lane)
        # The shift carries high bits down, so that products of lanes don't simply add up.
        was = other[rows]
        other[rows] = ((was ^ (was >> U64(29))) + lane) * U64(0xD6E8FEB86659FD93)
        rows = rows[n[rows] > first + 8]
    h = mix64(h + (other ^ (other >> U64(32))) * U64(0xE7037ED1A0B428DB))
    for i in np.flatnonzero(n > LANES).tolist():
        h[i] = xxhash.xxh3_64_intdigest(buf[at[i] : to[i]].tobytes())
    return h


def bounds(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of buf begin and end; starts: where texts begin, which words don't cross."""
    solid = ~SPACE[buf]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = starts[(starts > 0) & (starts < len(buf))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _words(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of buf and the index of the text each lies in; starts: where texts begin."""
    at, to = bounds(buf, starts)
    return hashes(_LOWER[buf], at, to), np.searchsorted(starts, at, side="right") - 1


def pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of one text of some CHUNK bytes that end where a word does."""
    at, stop = 0, len(data)
    while at < stop:
        to = min(at + CHUNK, stop)
        while to < stop and not SPACE[data[to]]:
            more = np.flatnonzero(SPACE[data[to : min(to + CHUNK, stop)]])
            to = to + int(more[0]) if len(more) else min(to + CHUNK, stop)
        yield at, to
        at = to


def word_codes(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, end row, word codes, row of each word) for runs of rows; A-Z is lower-cased, null is empty."""
    texts = pa.array(texts.to_pylist(), pa.large_binary()) if isinstance(texts, pa.ChunkedArray) else texts.cast(pa.large_string() if pa.types.is_string(texts.type) else texts.type)
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=n + 1, offset=texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    if texts.null_count:
        lengths = np.where(texts.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    else:
        lengths = np.diff(offsets)
    row = 0
    while row < n:
        end = row + 1
        if lengths[row] <= CHUNK:
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1)
            buf = data[offsets[row] : offsets[end]]
            if texts.null_count and np.any(lengths[row:end] != np.diff(offsets[row : end + 1])):
                buf = buf.copy()
                for r in np.flatnonzero(lengths[row:end] != np.diff(offsets[row : end + 1])) + row:
                    buf[offsets[r] - offsets[row] : offsets[r + 1] - offsets[row]] = 0x20
            codes, doc = _words(buf, offsets[row:end] - offsets[row]) if len(buf) else (np.zeros(0, U64), np.zeros(0, np.int64))
        else:
            own = data[offsets[row] : offsets[row + 1]]
            parts = [_words(own[at:to], np.zeros(1, np.int64))[0] for at, to in pieces(own)]
            codes = np.concatenate(parts)
            doc = np.zeros(len(codes), np.int64)
        yield row, end, codes, doc
        row = end


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Yields (first row, sorted distinct k-word shingle codes of each row). Fewer than k words: one code; no word: none."""
    for row, end, codes, doc in word_codes(texts):
        counts = np.bincount(doc, minlength=end - row)
        ends = np.cumsum(counts)
        n = max(0, len(codes) - k + 1)
        joined = np.zeros(n, dtype=U64)
        for j in range(k):
            joined = joined * U64(0xC2B2AE3D27D4EB4F) + codes[j : j + n]
        joined = mix64(joined + U64(k))
        out = []
        for stop, count in zip(ends.tolist(), counts.tolist(), strict=True):
            start = stop - count
            if count >= k:
                own = np.sort(joined[start : stop - k + 1])
                out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
            elif count:
                code = np.zeros(1, dtype=U64)
                for c in codes[start:stop]:
                    code = code * U64(0xC2B2AE3D27D4EB4F) + c
                out.append(mix64(code + U64(count)))
            else:
                out.append(np.zeros(0, dtype=U64))
        yield row, out
