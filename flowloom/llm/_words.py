"""Words of a whole Arrow batch at once: their places and 64-bit hashes, in NumPy, without a Python step per word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Moduli are prime: modulo a power of two, some pairs of words of 1,024 bytes agree whatever the base.
_FIELDS = ((2**31 - 1, 0x4B379A21), (2**31 - 19, 0x2545F491))  # (modulus, base)
_powers: list[tuple[np.ndarray, np.ndarray]] = [(np.ones(1, np.uint64), np.ones(1, np.uint64)) for _ in _FIELDS]

_code = np.arange(256)
#: White space that ends a word: space and the characters 9 to 13.
SPACE = (_code == 0x20) | ((_code >= 9) & (_code <= 13))
#: Everything in ASCII but letters and digits.
NOT_ALNUM = (_code < 128) & ~np.isin(_code, [*range(48, 58), *range(65, 91), *range(97, 123)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit hangs on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grown(field: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a field's base and of its inverse, up to n."""
    modulus, base = _FIELDS[field]
    while len(_powers[field][0]) <= n:
        size = len(_powers[field][0])
        steps = (np.uint64(pow(base, size, modulus)), np.uint64(pow(base, -size, modulus)))
        _powers[field] = tuple(np.concatenate([x, x * step % np.uint64(modulus)]) for x, step in zip(_powers[field], steps, strict=True))
    return _powers[field]


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each range of bytes: the mixed values of a polynomial modulo two primes of 31 bits, by a running sum over all bytes for each."""
    found = np.zeros(len(start), np.uint64)
    for field, (modulus, _) in enumerate(_FIELDS):
        p = np.uint64(modulus)
        power, inverse = _grown(field, len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)] % p, out=sums[1:])  # fits up to 2**33 bytes
        found = found << np.uint64(31) | (sums[end] - sums[start]) % p * inverse[start] % p
    return mix(found)


@dataclass
class Words:
    """Words of a batch in order. data: the batch's bytes; offsets: where each row begins; start, end, row, hash: of each word."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """The index of each row's first word, and at last the number of words."""
        return np.searchsorted(self.row, np.arange(len(self.offsets)))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its rows in them; null rows are empty."""
    texts = pc.fill_null(texts, "")
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def places_of(data: np.ndarray, names: list[bytes]) -> np.ndarray:
    """Whether each byte is the last of one of ``names``."""
    found = np.zeros(len(data), bool)
    for name in names:
        hit = np.ones(max(0, len(data) - len(name) + 1), bool)
        for k, byte in enumerate(name):
            hit &= data[k : k + len(hit)] == byte
        found[len(name) - 1 :] |= hit
    return found


def _ideographs(data: np.ndarray) -> np.ndarray:
    """Whether a kana or an ideograph, of three bytes, begins at each byte."""
    found = np.zeros(len(data), bool)
    found[:-2] = ((data[:-2] == 0xE3) & (data[1:-1] >= 0x81)) | ((data[:-2] >= 0xE4) & (data[:-2] <= 0xE9))
    return found


def words(texts: pa.Array, separators: np.ndarray = SPACE, lower: bool = False, marks: list[bytes] | None = None) -> Words:
    """The maximal runs of bytes that aren't ``separators`` in each text; with ``marks``, these part words too, and each ideograph is one."""
    data, offsets = raw(pc.utf8_lower(texts) if lower else texts)
    n = len(data)
    inside = ~separators[data]
    alone = np.zeros(n + 3, bool)
    if marks is not None:
        for name in {len(m) for m in marks}:
            ends = np.flatnonzero(places_of(data, [m for m in marks if len(m) == name]))
            inside[(ends[:, None] - np.arange(name)).ravel()] = False
        alone[:n] = _ideographs(data) & inside
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    apart = begins[: n + 1] | alone[: n + 1]  # before an ideograph and after it
    apart[3:] |= alone[: n - 2] if n > 2 else False
    start = np.flatnonzero(inside & (~before | apart[:n]))
    end = np.flatnonzero(inside & (~after | apart[1:])) + 1
    return Words(data, offsets, start, end, np.searchsorted(offsets, start, "right") - 1, range_hashes(data, start, end))


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of ``size`` words; a row of fewer words, but at least one, is a single run."""
    factor = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    n = len(w.hash)
    m = max(0, n - size + 1)
    total = np.zeros(m, np.uint64)
    for j in range(size):
        total += w.hash[j : j + m] * factor[j]
    whole = w.row[:m] == w.row[size - 1 :] if m else np.zeros(0, bool)
    row, found = w.row[:m][whole], mix(total[whole])
    first = w.first
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            has = count[short] > j
            extra[has] += w.hash[first[short[has]] + j] * factor[j]
        row, found = np.concatenate([row, short]), np.concatenate([found, mix(extra + count[short].astype(np.uint64))])
    return row, found
