"""Words and sets of five-word shingles as 64-bit numbers, many texts at a time."""

from __future__ import annotations

import numpy as np

WIDTH = 5

#: A-Z lowered; white space of the contract (space, 9 to 13) made one mark.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_STEP = int(_rng.integers(0, 1 << 63)) | 1
_BACK = pow(_STEP, -1, 1 << 64)
_PLACE = _rng.integers(0, 1 << 64, WIDTH, dtype=np.uint64) | np.uint64(1)
_SHORT = _rng.integers(0, 1 << 64, WIDTH, dtype=np.uint64)

#: Powers that are kept; a longer text has its own made.
_KEPT = 1 << 20
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base in _powers and n <= _KEPT:
        return _powers[base][:n]
    steps = np.full(max(n, _KEPT), base, dtype=np.uint64)
    steps[0] = 1
    np.cumprod(steps, dtype=np.uint64, out=steps)
    if n <= _KEPT:
        _powers[base] = steps
    return steps[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_numbers(texts: list[bytes | None], table: bytes = _LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts as 64-bit numbers, the place of each text's first, and how many each has.

    ``table`` maps bytes; what it maps to a space (32) separates words. Null has none.
    """
    joined = b" " + b" ".join((t or b"").translate(table) for t in texts) + b" "
    octets = np.frombuffer(joined, dtype=np.uint8)
    sizes = np.fromiter((len(t) if t else 0 for t in texts), dtype=np.int64, count=len(texts))
    begins = np.cumsum(sizes + 1) - sizes
    in_word = octets != 32
    start = np.flatnonzero(in_word[1:] & ~in_word[:-1]) + 1
    end = np.flatnonzero(in_word[:-1] & ~in_word[1:]) + 1
    total = np.cumsum(_BYTE[octets] * _power(_STEP, len(octets)), dtype=np.uint64)
    words = mix((total[end - 1] - total[start - 1]) * _power(_BACK, len(octets))[start])
    first = np.searchsorted(start, begins)
    return words, first, np.diff(np.concatenate([first, [len(start)]]))


def shingle_sets(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, ascending and end to end, and where each text's begin (with the end).

    A text with fewer words than a shingle has its whole sequence as one; a
    text without words, or null, has none.
    """
    words, first, count = word_numbers(texts)
    n = max(len(words) - WIDTH + 1, 0)
    windows = np.zeros(n, dtype=np.uint64)
    for k in range(WIDTH if n else 0):
        windows += words[k : k + n] * _PLACE[k]
    windows = mix(windows)
    out, sizes = [], np.zeros(len(texts) + 1, dtype=np.int64)
    for i, (at, m) in enumerate(zip(first.tolist(), count.tolist())):
        if m >= WIDTH:
            found = np.sort(windows[at : at + m - WIDTH + 1])
            if len(found) > 1:
                found = found[np.concatenate([[True], found[1:] != found[:-1]])]
        elif m:
            found = mix((words[at : at + m] * _PLACE[:m]).sum(keepdims=True) + _SHORT[m])
        else:
            continue
        out.append(found)
        sizes[i + 1] = len(found)
    return (np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)), np.cumsum(sizes)


def many_sets(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_sets`` of any number of texts, a bounded part at a time."""
    parts = [shingle_sets(texts[a:b]) for a, b in by_bytes(texts)]
    sizes = np.concatenate([[0], *(np.diff(bounds) for _, bounds in parts)]).astype(np.int64)
    return np.concatenate([np.zeros(0, dtype=np.uint64), *(sets for sets, _ in parts)]), np.cumsum(sizes)


def by_bytes(texts: list[bytes | None], most: int = 1 << 19):
    """Ranges of texts that hold about so many bytes each; one text may hold more."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= most:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
