"""Word hashes and shingles of whole texts, in numpy and Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


#: Random numbers for each place (modulo 64) and byte.
_TABLE = np.random.default_rng(5).integers(0, (1 << 64) - 1, 64 * 256, np.uint64, endpoint=True)


def string_hashes(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of strings: the sum of a random number for each place and byte, mixed with the length."""
    if not len(strings):
        return np.zeros(0, np.uint64)
    _, ends, data = strings.buffers()
    offsets = np.frombuffer(ends, np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    place = np.arange(len(raw)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    with np.errstate(over="ignore"):
        terms = _TABLE[(place & 63) << 8 | raw]
        if len(place) and place.max() > 63:
            terms *= ((place >> 6) * 2 + 1).astype(np.uint64)
        sums = np.append(np.uint64(0), np.cumsum(terms))
        return mix(sums[offsets[1:] - offsets[0]] - sums[offsets[:-1] - offsets[0]] + sizes.astype(np.uint64))


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def short_hashes(strings: pa.Array) -> np.ndarray:
    """Other 64-bit hashes, faster over many short strings: eight bytes a step, mixed with the length. Different strings of at most
    eight bytes and one length never have the same."""
    if not len(strings):
        return np.zeros(0, np.uint64)
    _, ends, data = strings.buffers()
    offsets = np.frombuffer(ends, np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    start, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
    words = np.ndarray((len(raw) + 1,), "<u8", np.append(raw, np.zeros(8, np.uint8)), strides=(1,))
    with np.errstate(over="ignore"):
        out = mix((words[start] & _MASKS[np.minimum(sizes, 8)]) + sizes.astype(np.uint64) * _STEP)
        for k in range(8, 64, 8):
            more = np.flatnonzero(sizes > k)
            if not len(more):
                break
            out[more] = mix((out[more] + _STEP) ^ (words[start[more] + k] & _MASKS[np.minimum(sizes[more] - k, 8)]))
    long = np.flatnonzero(sizes > 64)
    if len(long):
        out[long] = string_hashes(strings.take(pa.array(long)))
    return out


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs without ASCII white space) of all texts, and each text's number of words."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = lists.flatten().dictionary_encode()
    codes = words.indices.to_numpy(zero_copy_only=False)
    table = string_hashes(words.dictionary)
    real = np.asarray(pc.not_equal(words.dictionary, "")).astype(bool) if len(table) else np.zeros(0, bool)
    keep = real[codes] if len(codes) else np.zeros(0, bool)
    owner = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(lists)).astype(np.int64))
    return (table[codes[keep]] if len(codes) else np.zeros(0, np.uint64)), np.bincount(owner[keep], minlength=len(texts))


def shingles(texts: pa.Array, width: int, lowered: Callable[[pa.Array], pa.Array] = pc.utf8_lower) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct shingles' hashes, ascending, and how often each occurs. A text of fewer than `width`
    words, but some, is one shingle."""
    hashes, counts = word_hashes(lowered(texts))
    total = np.zeros_like(hashes)
    with np.errstate(over="ignore"):
        for k in range(width):
            total[: len(hashes) - k] += mix(hashes[k:] + np.uint64(k + 1) * _STEP)
        total = mix(total)
        start = 0
        for n in counts:
            n = int(n)
            if n >= width:
                found = np.sort(total[start : start + n - width + 1])
            elif n:
                found = mix(np.array([sum(int(h) * (k + 3) for k, h in enumerate(hashes[start : start + n])) & 0xFFFFFFFFFFFFFFFF], np.uint64))
            else:
                found = np.zeros(0, np.uint64)
            start += n
            first = np.append(True, found[1:] != found[:-1])[: len(found)]
            places = np.flatnonzero(first)
            yield found[places], np.diff(np.append(places, len(found)))
