"""Literals that every match of a regular expression holds, for prefilters that lose nothing."""

from __future__ import annotations

from itertools import product
from re import _constants as K
from re import _parser

#: Most strings that one stretch of a pattern is spelled out to.
_MOST = 256


def _finite(items: list) -> set[str] | None:
    """The lower-cased strings that a sequence of parsed items matches, if known and few, else None."""
    out = {""}
    for op, arg in items:
        if op is K.LITERAL:
            got = {chr(arg).lower()}
        elif op is K.IN and all(o in (K.LITERAL, K.RANGE) for o, _ in arg):
            got = {chr(x).lower() for o, a in arg for x in (range(a[0], a[1] + 1) if o is K.RANGE else (a,))}
        elif op is K.BRANCH:
            parts = [_finite(x) for x in arg[1]]
            got = None if None in parts else set().union(*parts)
        elif op is K.SUBPATTERN:
            got = _finite(arg[3])
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[1] <= 4:
            one = _finite(arg[2])
            got = None if one is None or len(one) ** arg[1] > _MOST else {"".join(x) for n in range(arg[0], arg[1] + 1) for x in product(one, repeat=n)}
        elif op in (K.AT, K.ASSERT, K.ASSERT_NOT):
            got = {""}
        else:
            got = None
        if got is None or len(out) * len(got) > _MOST:
            return None
        out = {a + b for a in out for b in got}
    return out


def _score(c: set[str]) -> tuple[int, int]:
    return (min(map(len, c)), -len(c))


def _cover(items: list) -> set[str] | None:
    """Strings of which each match holds one (best known), or None."""
    items, best = list(items), None
    for i in range(len(items)):
        for j in range(i + 1, len(items) + 1):
            c = _finite(items[i:j])
            if c is None:
                break
            if "" not in c and (best is None or _score(c) > _score(best)):
                best = c
        op, arg = items[i]
        c = None
        if op is K.BRANCH:
            parts = [_cover(x) for x in arg[1]]
            c = None if None in parts else set().union(*parts)
        elif op is K.SUBPATTERN:
            c = _cover(arg[3])
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[0]:
            c = _cover(list(arg[2]) * min(arg[0], 4))
        if c is not None and (best is None or _score(c) > _score(best)):
            best = c
    return best


def cover(pattern: str) -> set[str]:
    """Lower-cased strings of which each match of ``pattern``, lower-cased, holds at least one: long and few ones."""
    found = _cover(_parser.parse(pattern))
    if not found:
        raise ValueError(f"a match need not hold any literal: {pattern}")
    return found
