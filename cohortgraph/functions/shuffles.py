"""Random permutations that need no shared state: place k of n goes to a place that only the seed, the permutation and k tell."""

from __future__ import annotations

import numpy as np

#: Rounds for large n; small halves have few round functions and take more.
_ROUNDS = 6


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit number reaches every other."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _stirred(x: np.ndarray) -> np.ndarray:
    """The same for 32 bits, in place."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    x ^= x >> np.uint32(16)
    return x


def _keys(seed: int, perms: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(perms.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(salt) * np.uint64(0x165667B19E3779F9))


def places(n: int, k: np.ndarray, perms: np.ndarray, seed: int = 0) -> np.ndarray:
    """[perm, k]: where k goes in each permutation of 0 .. n - 1.

    A Feistel network permutes the numbers of an even count of bits that holds n; what lands beyond n goes through it again, so
    that 0 .. n - 1 are permuted among themselves."""
    half = max(3, ((n - 1).bit_length() + 1) // 2)
    low = np.uint32((1 << half) - 1)
    keys = [_keys(seed, perms, r + 1).astype(np.uint32) for r in range(max(_ROUNDS, 36 // half))]

    def through(x: np.ndarray, of) -> np.ndarray:
        a, b = (x >> half).astype(np.uint32), x.astype(np.uint32) & low
        for key in keys:
            a, b = b, a ^ (_stirred(b + of(key)) & low)
        return (a.astype(np.int64) << half) | b

    out = through(np.asarray(k, np.int64)[None, :], lambda key: key[:, None])
    todo = np.flatnonzero(out.ravel() >= n)
    flat = out.reshape(-1)
    while len(todo):
        rows = todo // len(k)
        flat[todo] = through(flat[todo], lambda key: key[rows])
        todo = todo[flat[todo] >= n]
    return out


def bootstrap_block(n: int, na: int, size: int, leaf: int, rounds: int, seed: int = 0, stream: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """([round, subject] copies, and those of them in group a) of the subjects size * leaf .. of a bootstrap with shuffled groups.

    In each round na copies are drawn from the first na of n subjects and the others from the rest, with replacement; then na
    of all n copies are group a. A block draws its own share alone: from the root of a tree over blocks, the copies and
    the places of group a that fall to a half follow a binomial and a hypergeometric law, given those of the whole, and each
    node has its own stream of random numbers, so blocks that share a node agree. Inside the block, subjects split in turn."""
    leaves = -(-n // size)
    lo, hi = 0, leaves
    part = lambda x, y: (max(0, min(na, y * size) - x * size), max(0, min(n, y * size) - max(na, x * size)))  # noqa: E731  subjects of both cohorts in leaves x .. y - 1
    held = [np.full(rounds, na), np.full(rounds, n - na)]
    in_a, node = np.full(rounds, na), 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng, whole, half = np.random.default_rng([seed, stream, node, 1]), part(lo, hi), part(lo, mid)
        left = [rng.binomial(c, h / w) if w else c for c, h, w in zip(held, half, whole)]
        mine = rng.hypergeometric(left[0] + left[1], held[0] + held[1] - left[0] - left[1], in_a)
        if leaf < mid:
            hi, held, in_a, node = mid, left, mine, 2 * node
        else:
            lo, held, in_a, node = mid, [c - x for c, x in zip(held, left)], in_a - mine, 2 * node + 1
    rng, sizes = np.random.default_rng([seed, stream, node, 2]), part(lo, hi)
    copies = np.concatenate([rng.multinomial(c, np.full(k, 1 / k)) if k else np.zeros((rounds, 0), np.int64) for c, k in zip(held, sizes)], axis=1)
    first, rest = np.zeros_like(copies), copies.sum(axis=1)
    for k in range(copies.shape[1]):
        rest = rest - copies[:, k]
        first[:, k] = rng.hypergeometric(copies[:, k], rest, in_a)
        in_a = in_a - first[:, k]
    return copies, first
