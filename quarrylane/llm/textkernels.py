"""Array kernels over whole texts: word hashes, k-mers, banded alignment."""

from __future__ import annotations

import numpy as np

_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Words are runs of ASCII letters and digits and of all bytes beyond ASCII.
WORD_BYTE = np.array([chr(b).isalnum() or b >= 128 for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_POWER = np.ones(256, np.uint64)
with np.errstate(over="ignore"):
    for _k in range(1, 256):
        _POWER[_k] = _POWER[_k - 1] * np.uint64(0x100000001B3)


def run_hashes(data: np.ndarray, inside: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of every run of bytes that are inside, in order; first gives other starts among those bytes."""
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64)
    if first is None:
        first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    pos = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    power = _POWER[pos & 255] + (pos >> 8).astype(np.uint64)
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(_BYTE[data[at]] * power, first))


def text_bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the lower-cased words; punctuation and white space only separate."""
    data = text_bytes(text.lower())
    return run_hashes(data, WORD_BYTE[data])


def kmers(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; of all words at once when there are fewer."""
    k = min(k, len(words))
    if not k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = (out + words[j : j + len(out)]) * np.uint64(0x100000001B3)
    return mix(out)


def occurrences(values: np.ndarray) -> np.ndarray:
    """How many equal values stand before each one."""
    order = np.argsort(values, kind="stable")
    s = values[order]
    new = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    rank = np.arange(len(s)) - np.repeat(new, np.diff(np.append(new, len(s))))
    out = np.empty(len(s), np.uint64)
    out[order] = rank.astype(np.uint64)
    return out


def order_minhash(words: np.ndarray, k: int, take: int, sketches: int, block: int = 1 << 16) -> np.ndarray:
    """One key per sketch: the ``take`` least occurrence-labelled k-mers under the sketch's hash, in text order.

    The labelled k-mers are well-mixed numbers of 32 bits, so a sketch's hash is a product with its own odd number. All
    sketches run at once over blocks of k-mers; a block's least ones compete with those of the blocks before it.
    """
    grams = kmers(words, k)
    n = len(grams)
    if not n:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        labelled = (mix(grams + occurrences(grams) * _GOLD) >> np.uint64(32)).astype(np.uint32)
        wide = mix(np.arange(1, sketches + 1, dtype=np.uint64) * _GOLD)
        odd = (wide >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        best = np.full((sketches, 0), 0)
        for low in range(0, n, block):
            spots = np.arange(low, min(n, low + block))
            if low:
                spots = np.concatenate([np.broadcast_to(spots, (sketches, len(spots))), best], axis=1)
                x = labelled[spots] * odd[:, None]
            else:
                x = labelled[:block] * odd[:, None]
            found = []
            for _ in range(min(take, x.shape[1])):
                at = x.argmin(axis=1)
                found.append(spots[at] if spots.ndim == 1 else spots[np.arange(sketches), at])
                x[np.arange(sketches), at] = np.uint32(0xFFFFFFFF)
            best = np.stack(found, axis=1)
        keys = wide
        for column in np.sort(best, axis=1).T:
            keys = mix(keys * np.uint64(0x100000001B3) + grams[column])
    return keys.view(np.int64)


def _whole_distance(a: list, where: dict, m: int) -> int:
    """Edit distance to a sequence of m symbols given by their places, without a band."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score = full, 0, m
    for x in a:
        p = where.get(x, 0) | vn
        d0 = ((((p & vp) + vp) ^ vp) | p) & full
        hp, hn = (vn | ~(d0 | vp)) & full, d0 & vp
        score += bool(hp & top) - bool(hn & top)
        hp = ((hp << 1) | 1) & full
        vp, vn = ((hn << 1) | ~(d0 | hp)) & full, d0 & hp
    return score


def banded_distance(a: list, b: list, most: int) -> int:
    """Edit distance of two sequences if it is at most ``most``, else most + 1.

    Bit-parallel columns of a band of 2 * most + 2 diagonals that moves down one row per column.
    """
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > most:
        return most + 1
    if not m:
        return n
    where: dict = {}
    for i, x in enumerate(b):
        where[x] = where.get(x, 0) | (1 << i)
    if most >= m:
        return min(_whole_distance(a, where, m), most + 1)
    width = 2 * most + 2
    full = (1 << width) - 1
    vp, vn = (full << (width - most - 1)) & full, 0
    score, start = most, most + 1 - width
    top = 1 << (width - 1)
    side = 1 << (width - 2)
    limit = most + n - (m - most)
    turn = m - most
    for i in range(n):
        p = where.get(a[i], 0)
        x = ((p >> start) if start >= 0 else (p << -start)) & full
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        if i < turn:
            score += not d0 & top
        else:
            score += bool(hp & side) - bool(hn & side)
            side >>= 1
        if score > limit:
            return most + 1
        half = d0 >> 1
        vp = (hn | ~(half | hp)) & full
        vn = half & hp
        start += 1
    return score if score <= most else most + 1


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the edit similarity (1 - edits / longer length) of two word sequences is at least ``least``."""
    n = max(len(a), len(b))
    most = int(np.floor((1 - least) * n + 1e-9))
    if abs(len(a) - len(b)) > most:
        return False
    m = min(len(a), len(b))
    differ = np.flatnonzero(a[:m] != b[:m])
    if not len(differ):
        return True
    head = differ[0]
    tails = np.flatnonzero(a[len(a) - m :][::-1] != b[len(b) - m :][::-1])
    if not len(tails):
        return True
    tail = min(tails[0], m - head)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(a) == len(b) and np.count_nonzero(a != b) <= most:
        return True
    va, ca = np.unique(a, return_counts=True)
    vb, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    if max(len(a), len(b)) - int(np.minimum(ca[ia], cb[ib]).sum()) > most:
        return False
    x, y = a.tolist(), b.tolist()
    narrow = max(16, abs(len(a) - len(b)), most // 8)
    if narrow < most and banded_distance(x, y, narrow) <= narrow:
        return True
    return banded_distance(x, y, most) <= most
