"""Regular expressions to necessary trigrams, after Cox's published derivation.

For every subexpression five facts are kept: whether it matches empty, its exact set of
strings (if small), sets of prefixes and suffixes, and a query that every match meets.
A query is ALL, NONE, ("key", k), ("and", parts) or ("or", parts).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from re import _constants as sc
from re import _parser as sp

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALL, NONE = ("all",), ("none",)
MOST_CLASS, MOST_EXACT, MOST_LENGTH, MOST_SET, MOST_KEYS, MOST_UNROLL = 4, 7, 4, 20, 64, 8


def _fold(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def keys_of(text: str) -> list[str]:
    return sorted({text[i : i + 3] for i in range(len(text) - 2)})


def conjoin(parts) -> tuple:
    flat: list[tuple] = []
    for p in parts:
        if p == NONE:
            return NONE
        if p != ALL:
            flat += list(p[1]) if p[0] == "and" else [p]
    flat = list(dict.fromkeys(flat))
    return ALL if not flat else flat[0] if len(flat) == 1 else ("and", tuple(flat))


def disjoin(parts) -> tuple:
    flat: list[tuple] = []
    for p in parts:
        if p == ALL:
            return ALL
        if p != NONE:
            flat += list(p[1]) if p[0] == "or" else [p]
    flat = list(dict.fromkeys(flat))
    return NONE if not flat else flat[0] if len(flat) == 1 else ("or", tuple(flat))


def _any_of(strings: set[str]) -> tuple:
    """Every match holds one of the strings."""
    if not strings or any(len(s) < 3 for s in strings):
        return ALL
    return disjoin([conjoin([("key", k) for k in keys_of(s)]) for s in sorted(strings)])


@dataclass
class Info:
    empty: bool
    exact: set[str] | None
    prefix: set[str]
    suffix: set[str]
    match: tuple

    def settled(self) -> Info:
        """Keep the sets small; what they lose goes into the query."""
        match = self.match
        if self.exact is not None and (len(self.exact) > MOST_EXACT or any(len(s) > MOST_LENGTH for s in self.exact)):
            match = conjoin([match, _any_of(self.exact)])
            prefix, suffix = {s[:3] for s in self.exact}, {s[-3:] for s in self.exact}
            return Info(self.empty, None, prefix, suffix, match).settled()
        prefix, suffix = self.prefix, self.suffix
        if self.exact is None:
            match = conjoin([match, _any_of(prefix), _any_of(suffix)])
            for n in (3, 2, 1, 0):
                if len({s[:n] for s in prefix}) <= MOST_SET:
                    prefix = {s[:n] for s in prefix}
                    break
            for n in (3, 2, 1, 0):
                cut = {s[-n:] if n else "" for s in suffix}
                if len(cut) <= MOST_SET:
                    suffix = cut
                    break
        return Info(self.empty, self.exact, prefix, suffix, match)


def _literal(strings: set[str]) -> Info:
    return Info("" in strings, strings, strings, strings, ALL).settled()


def _anything(empty: bool) -> Info:
    return Info(empty, None, {""}, {""}, ALL)


def _concat(a: Info, b: Info) -> Info:
    match = conjoin([a.match, b.match])
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= 64:
        both = {x + y for x in a.exact for y in b.exact}
        return Info(a.empty and b.empty, both, both, both, match).settled()
    prefix = {x + y for x in a.exact for y in b.prefix} if a.exact is not None else (a.prefix | b.prefix if a.empty else a.prefix)
    suffix = {x + y for x in a.suffix for y in b.exact} if b.exact is not None else (b.suffix | a.suffix if b.empty else b.suffix)
    if a.exact is None and b.exact is None and len(a.suffix) * len(b.prefix) <= MOST_SET:
        match = conjoin([match, _any_of({x + y for x in a.suffix for y in b.prefix})])
    return Info(a.empty and b.empty, None, prefix, suffix, match).settled()


def _either(a: Info, b: Info) -> Info:
    if a.exact is not None and b.exact is not None:
        return Info(a.empty or b.empty, a.exact | b.exact, a.prefix | b.prefix, a.suffix | b.suffix, disjoin([a.match, b.match])).settled()
    full = [conjoin([x.match, _any_of(x.exact)]) if x.exact is not None else x.match for x in (a, b)]
    return Info(a.empty or b.empty, None, a.prefix | b.prefix, a.suffix | b.suffix, disjoin(full)).settled()


def _walk(items) -> Info:
    out = _literal({""})
    for op, arg in items:
        out = _concat(out, _one(op, arg))
    return out


def _one(op, arg) -> Info:
    if op is sc.LITERAL:
        return _literal({_fold(chr(arg))})
    if op is sc.IN:
        letters: set[str] = set()
        for kind, value in arg:
            if kind is sc.LITERAL:
                letters.add(_fold(chr(value)))
            elif kind is sc.RANGE and value[1] - value[0] < 64:
                letters |= {_fold(chr(c)) for c in range(value[0], value[1] + 1)}
            else:
                return _anything(False)
        return _literal(letters) if len(letters) <= MOST_CLASS else _anything(False)
    if op in (sc.ANY, sc.NOT_LITERAL):
        return _anything(False)
    if op is sc.SUBPATTERN:
        return _walk(arg[3])
    if op is sc.BRANCH:
        return reduce(_either, [_walk(x) for x in arg[1]])
    if op in (sc.MAX_REPEAT, sc.MIN_REPEAT, getattr(sc, "POSSESSIVE_REPEAT", None)):
        low, high, body = arg
        one = _walk(body)
        if (low, high) == (0, 1):
            return _either(one, _literal({""}))
        if low == 0:
            return _anything(True)
        out = one
        for _ in range(min(low, MOST_UNROLL) - 1):
            out = _concat(out, one)
        if high == low and low <= MOST_UNROLL:
            return out
        # more may follow: what is known is a start and an end of it
        match = conjoin([out.match, _any_of(out.exact)]) if out.exact is not None else out.match
        return Info(out.empty, None, out.prefix, one.suffix, match).settled()
    if op in (sc.AT, sc.ASSERT, sc.ASSERT_NOT):
        return _literal({""})
    return _anything(True)


def derive(pattern: str, flags: int = 0) -> tuple:
    """The query that every text matching the pattern meets (trigrams ASCII-folded).
    Letters that other cases than ASCII's fold to give up their trigrams."""
    tree = sp.parse(pattern, flags)
    info = _walk(tree)
    query = conjoin([info.match, _any_of(info.exact)]) if info.exact is not None else info.match
    folds = (flags | tree.state.flags) & re.IGNORECASE
    return _without(query, lambda k: not k.isascii() or (folds and any(c in "ks" for c in k)))


def _without(q: tuple, drop) -> tuple:
    if q[0] == "key":
        return ALL if drop(q[1]) else q
    if q[0] in ("and", "or"):
        return (conjoin if q[0] == "and" else disjoin)([_without(p, drop) for p in q[1]])
    return q


def keys(q: tuple) -> set[str]:
    return {q[1]} if q[0] == "key" else {k for p in q[1] for k in keys(p)} if q[0] in ("and", "or") else set()


def holds(q: tuple, has) -> bool:
    if q[0] == "key":
        return has(q[1])
    if q[0] in ("and", "or"):
        return (all if q[0] == "and" else any)(holds(p, has) for p in q[1])
    return q == ALL


def weaken(q: tuple, df: dict[str, int], most_keys: int = MOST_KEYS, rarest: int = 4) -> tuple:
    """Keep the rarest children of every AND and all of an OR; beyond ``most_keys`` the
    most frequent keys go."""
    if q[0] == "and":
        cost = lambda p: df.get(p[1], 0) if p[0] == "key" else sum(df.get(k, 0) for k in keys(p))
        q = conjoin([weaken(p, df, most_keys, rarest) for p in sorted(q[1], key=cost)[:rarest]])
    elif q[0] == "or":
        q = disjoin([weaken(p, df, most_keys, rarest) for p in q[1]])
    own = sorted(keys(q), key=lambda k: (df.get(k, 0), k))
    if len(own) > most_keys:
        gone = set(own[most_keys:])
        q = _without(q, lambda k: k in gone)
    return q


def candidates(grams: DataFrame, q: tuple) -> DataFrame | None:
    """doc_id of the documents that meet the query, from (key, doc_id) postings; None
    where every document does. Only the asked keys are read; documents meet the tree by
    one aggregation over their found keys."""
    if q == ALL:
        return None
    wanted = sorted(keys(q))
    if not wanted:
        return grams.select("doc_id").limit(0)
    rows = grams.filter(F.col("key").isin(*wanted)).groupBy("doc_id").agg(F.collect_set("key").alias("found"))

    def test(p: tuple):
        if p[0] == "key":
            return F.array_contains("found", p[1])
        parts = [test(x) for x in p[1]]
        return reduce((lambda a, b: a & b) if p[0] == "and" else (lambda a, b: a | b), parts)

    return rows.filter(test(q)).select("doc_id")


def required_literal(pattern: str) -> str:
    """The longest literal that every match holds, from the top level of a regex."""
    best = run = ""
    for op, arg in sp.parse(pattern):
        if op is sc.LITERAL:
            run += chr(arg)
        elif op is not sc.AT:
            run = ""
        best = max(best, run, key=len)
    return best
