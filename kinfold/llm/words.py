"""Words of UTF-8 texts as 64-bit hashes, computed for a whole Arrow batch at a time.

A word is a maximal run of bytes other than space and the control characters 9 to 13. All of these are
single bytes in UTF-8, so words can be found without decoding. No hash here is a polynomial modulo a power
of two over bytes, which texts could make collide whatever its constants.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

_U = np.uint64
#: Spans of more bytes than this are hashed by BLAKE2b, one by one.
_SHORT = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)
#: Two primes below 2**31 and a base for each.
_FIELDS = ((2**31 - 1, 1_103_515_245), (2**31 - 19, 1_812_433_253))
_BLOCK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads each bit over all others (the splitmix64 finalizer)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def salted(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit integers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """The bytes with A to Z in lower case."""
    upper = (data >= 65) & (data <= 90)
    return data + (upper.astype(np.uint8) << 5)


def separators(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def spans(apart: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without separators; runs end where a text ends."""
    inside = ~apart
    edge = np.zeros(len(apart) + 1, bool)
    edge[bounds] = True
    starts = np.flatnonzero(inside & (edge[:-1] | np.append(True, apart)[:-1]))
    ends = np.flatnonzero(inside & (edge[1:] | np.append(apart, True)[1:])) + 1
    return starts, ends


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes: eight bytes at a time, each mixed in after the last."""
    sizes = ends - starts
    aligned = np.zeros(len(data) // 8 + 2, "<u8")
    aligned.view(np.uint8)[: len(data)] = data
    with np.errstate(over="ignore"):
        out = mix(sizes.astype(_U) * _U(0xD6E8FEB86659FD93) + _U(0x9E3779B97F4A7C15))
        at, place, left = np.arange(len(starts)), starts, sizes
        while len(at):
            word, shift = place >> 3, ((place & 7) << 3).astype(_U)
            piece = (aligned[word] >> shift) | (aligned[word + 1] << (_U(63) - shift) << _U(1))
            out[at] = mix((out[at] ^ (piece & _MASKS[np.minimum(left, 8)])) * _U(0xFF51AFD7ED558CCD))
            more = np.flatnonzero((left > 8) & (sizes[at] <= _SHORT))
            at, place, left = at[more], place[more] + 8, left[more] - 8
    for k in np.flatnonzero(sizes > _SHORT):
        digest = hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8).digest()
        out[k] = int.from_bytes(digest, "little")
    return out


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and each text's bounds among them."""
    starts, ends = spans(separators(data), bounds)
    return hash_spans(data, starts, ends), np.searchsorted(starts, bounds)


def window_hashes(words: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, also of those that cross from one text into the next."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, _U)
    with np.errstate(over="ignore"):
        for k, factor in enumerate(salted(seed, width) | _U(1)):
            out += words[k : k + n] * factor
        return mix(out)


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(1, _U)
    while len(out) < n:
        out = np.concatenate((out, out * _U(pow(base, len(out), prime)) % _U(prime)))
    return out[:n]


@lru_cache(maxsize=4)
def _tables(width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    n = _BLOCK + width
    return [(_powers(base, prime, n), _powers(pow(base, -1, prime), prime, n)) for prime, base in _FIELDS]


def rolling_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes of all runs of ``width`` words, each from the one before by one step.

    The difference of two values of the running polynomial, divided by the power at the window's start, is
    the window's hash. One half of each word's hash goes through one prime, the other half through the other.
    """
    n = max(0, len(words) - width + 1)
    out = np.empty(n, _U)
    for at in range(0, n, _BLOCK):
        part = words[at : at + _BLOCK + width - 1]
        m = len(part) - width + 1
        joined = np.zeros(m, _U)
        for (prime, _), (power, inverse), half in zip(_FIELDS, _tables(width), (part >> _U(33), part & _U(2**31 - 1))):
            total = np.zeros(len(part) + 1, _U)
            np.cumsum(half * power[: len(part)] % _U(prime), out=total[1:])
            joined = joined << _U(31) | (total[width:] - total[:-width]) % _U(prime) * inverse[:m] % _U(prime)
        with np.errstate(over="ignore"):
            out[at : at + m] = mix(joined)
    return out
