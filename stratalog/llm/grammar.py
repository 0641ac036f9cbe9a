"""Re-Pair grammars of many token sequences at once."""

from __future__ import annotations

import numpy as np

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A 64-bit name for each pair; the same pair has the same name in every sequence."""
    h = x * _A ^ (y + _B + (x << np.uint64(13)))
    h ^= h >> np.uint64(29)
    h *= _B
    return h ^ (h >> np.uint64(32))


def repair(symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grammars of the sequences that ``symbols`` holds one after the other; ``owner`` (ascending) tells which is whose.

    Returns for each sequence 0..max(owner): symbols left in its start rule, its number of rules, and the most uses of
    one rule. As in Re-Pair a pair is replaced by a new symbol while one occurs twice, the frequent first. A
    round takes in each sequence all pairs at least half as frequent as its most frequent one; of overlapping places
    the more frequent pair wins, then the one with the larger name, then the left. Sequences without a pair that recurs drop out.
    """
    n = int(owner[-1]) + 1 if len(owner) else 0
    left, rules, most = np.bincount(owner, minlength=n).astype(np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    s, f = symbols.astype(np.uint64), owner.astype(np.int64)
    with np.errstate(over="ignore"):
        while len(s) >= 2:  # each round shrinks it or is the last
            name = mix(s[:-1], s[1:])
            inside = f[:-1] == f[1:]
            key = mix(name, f[:-1].astype(np.uint64))
            key[~inside] = np.arange((~inside).sum(), dtype=np.uint64)  # never recurs
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
            sizes = np.diff(np.r_[first, len(ranked)])
            count = np.empty(len(key), np.int64)
            count[order] = np.repeat(sizes, sizes)
            count[~inside] = 0
            top = np.zeros(n, np.int64)
            np.maximum.at(top, f[:-1], count)
            take = (count >= 2) & (2 * count >= top[f[:-1]])
            # in a run of one symbol only every other place can be taken
            i = np.arange(len(key))
            start = np.ones(len(key), bool)
            start[1:] = key[1:] != key[:-1]
            take &= (i - np.maximum.accumulate(np.where(start, i, 0))) % 2 == 0
            rank = np.where(take, count.astype(np.float64) + (name >> np.uint64(12)).astype(np.float64) / 2.0**53, 0.0)
            before, after = np.r_[0.0, rank[:-1]], np.r_[rank[1:], 0.0]
            place = (rank > 0) & (rank > before) & (rank >= after)
            same = np.flatnonzero(place[:-1] & place[1:])
            place[same + 1] = False
            at = np.flatnonzero(place)
            if not len(at):
                break
            # keep only pairs that still have two places
            chosen = key[at]
            o = np.argsort(chosen, kind="stable")
            c = chosen[o]
            start = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            many = np.diff(np.r_[start, len(c)])
            uses = np.empty(len(at), np.int64)
            uses[o] = np.repeat(many, many)
            good = uses >= 2
            if not good.any():
                alone = np.zeros(n, bool)
                alone[f[at]] = True
                keep = ~alone[f]  # a run such as aaa has but one place: no rule
                s, f = s[keep], f[keep]
                continue
            owners_of_rules = f[at[o[start]]][many >= 2]
            np.add.at(rules, owners_of_rules, 1)
            np.maximum.at(most, owners_of_rules, many[many >= 2])
            at = at[good]
            left -= np.bincount(f[at], minlength=n)
            s = s.copy()
            s[at] = name[at]
            keep = np.ones(len(s), bool)
            keep[at + 1] = False
            live = np.zeros(n, bool)
            live[f[:-1][count >= 2]] = True  # only these can have further rules
            keep &= live[f]
            s, f = s[keep], f[keep]
    return left, rules, most
