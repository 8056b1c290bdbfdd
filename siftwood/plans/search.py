"""The boolean search language: arguments to a tree of atoms to columns.

Content atoms are nullable booleans where an index answers them (null: maybe), and the
connectives are Spark's own three-valued AND, OR, NOT. Rows without a document make
content atoms false.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwood.functions import patterns as P
from siftwood.functions.text import byte_offset, normalize_token, text_match, tokens

MOST_DEPTH = 32
UNITS = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "y": 365 * 86400}
KINDS = {"f": "file", "file": "file", "d": "dir", "dir": "dir", "l": "symlink", "link": "symlink"}


class SearchError(ValueError):
    """A query that the grammar refuses; ``kind`` names the reason."""

    def __init__(self, kind: str, detail: str = "") -> None:
        super().__init__(f"{kind}: {detail}" if detail else kind)
        self.kind = kind


@dataclass(frozen=True)
class Atom:
    kind: str
    value: object
    fold: bool = True

    def test(self, row: Callable[[str], Column], now: int) -> Column:
        """The atom over columns name, path, kind, size, mtime_s and text."""
        v = self.value
        if self.kind in ("name", "path"):
            c = row(self.kind)
            return P.ascii_lower(c).contains(P.fold_ascii(v)) if self.fold else c.contains(v)
        if self.kind in ("glob", "path-glob"):
            c = row("path" if self.kind == "path-glob" else "name")
            hit, literal = c.rlike(P.search_glob(v, self.fold)), P.glob_literal(v)
            # the longest literal rules out most rows before the regex
            cheap = P.ascii_lower(c).contains(P.fold_ascii(literal)) if self.fold else c.contains(literal)
            return (cheap & hit) if literal else hit
        if self.kind == "re":
            return row("name").rlike(("(?iu)" if self.fold else "") + v)
        if self.kind == "ext":
            c, suffix = (P.ascii_lower(row("name")), P.fold_ascii("." + v)) if self.fold else (row("name"), "." + v)
            return c.endswith(suffix) & (F.octet_length(row("name")) > len(suffix.encode()))
        if self.kind == "name-term":
            return F.array_contains(tokens(row("name")), v)
        if self.kind == "size":
            return _compare(row("size"), *v)
        if self.kind == "mtime":
            return _compare(F.lit(now) - row("mtime_s"), *v)
        if self.kind == "type":
            return row("kind") == v
        if self.kind == "text":
            return F.coalesce(text_match(row("text"), v, not self.fold), F.lit(False))
        if self.kind == "grep":
            return F.coalesce(row("text").rlike("(?m)" + v), F.lit(False))
        raise AssertionError(self.kind)


def _compare(column: Column, op: str, value: int) -> Column:
    return column < value if op == "<" else column > value if op == ">" else column == value


@dataclass(frozen=True)
class Node:
    op: str
    children: tuple

    def test(self, atom: Callable[[Atom], Column]) -> Column:
        parts = [c.test(atom) if isinstance(c, Node) else atom(c) for c in self.children]
        if self.op == "not":
            return ~parts[0]
        out = parts[0] if parts else F.lit(self.op == "and")
        for p in parts[1:]:
            out = (out & p) if self.op == "and" else (out | p)
        return out

    def atoms(self) -> list[Atom]:
        return [a for c in self.children for a in (c.atoms() if isinstance(c, Node) else [c])]


def parse_atom(text: str, fold: bool = True) -> Atom:
    head, colon, rest = text.partition(":")
    if not colon or head not in ("name", "path", "re", "ext", "name-term", "size", "mtime", "type", "text", "content", "grep"):
        if not text:
            raise SearchError("empty-atom")
        if P.has_glob(text):
            return Atom("path-glob" if "/" in text else "glob", text, fold)
        return Atom("path" if "/" in text else "name", text, fold)
    if not rest:
        raise SearchError("empty-value", text)
    if head == "name" and P.has_glob(rest):
        return Atom("glob", rest, fold)
    if head == "path" and P.has_glob(rest):
        return Atom("path-glob", rest, fold)
    if head in ("re", "grep"):
        try:
            re.compile(rest)
        except re.error as e:
            raise SearchError("bad-regex", str(e)) from e
    if head == "ext" and "/" in rest:
        raise SearchError("bad-extension", rest)
    if head == "name-term":
        if (rest := normalize_token(rest)) is None:
            raise SearchError("bad-token", text)
    if head == "size":
        m = re.fullmatch(r"([<>]?)([0-9]+)([kKmMgGtT]?)", rest)
        if not m:
            raise SearchError("bad-size", rest)
        n = int(m[2]) * UNITS[m[3].lower()]
        if n >= 1 << 63:
            raise SearchError("size-overflow", rest)
        return Atom("size", (m[1], n))
    if head == "mtime":
        m = re.fullmatch(r"([<>])([0-9]+)([smhdwy])", rest)
        if not m:
            raise SearchError("bad-age", rest)
        return Atom("mtime", (m[1], int(m[2]) * SECONDS[m[3]]))
    if head == "type":
        if rest not in KINDS:
            raise SearchError("bad-type", rest)
        return Atom("type", KINDS[rest])
    if head in ("text", "content"):
        if not re.search(r"\w", rest):
            raise SearchError("no-token", rest)
        return Atom("text", rest, fold)
    return Atom(head, rest, fold)


def parse(args: list[str]) -> Node:
    """AND binds tighter than OR, NOT tightest; adjacent terms AND; [] holds for all."""
    at = 0

    def word() -> str | None:
        return args[at] if at < len(args) else None

    def is_op(w: str | None, *names: str) -> bool:
        return w is not None and w.upper() in names

    def either(depth: int) -> Node:
        nonlocal at
        parts = [both(depth)]
        while is_op(word(), "OR"):
            at += 1
            parts.append(both(depth))
        return parts[0] if len(parts) == 1 else Node("or", tuple(parts))

    def both(depth: int) -> Node:
        nonlocal at
        parts = []
        while word() is not None and word() != ")" and not is_op(word(), "OR"):
            if is_op(word(), "AND"):
                if not parts:
                    raise SearchError("missing-operand", "AND")
                at += 1
                if word() is None or word() == ")" or is_op(word(), "OR", "AND"):
                    raise SearchError("missing-operand", "AND")
            parts.append(term(depth))
        if not parts:
            raise SearchError("empty-group" if word() == ")" else "missing-operand")
        flat = [x for p in parts for x in (p.children if isinstance(p, Node) and p.op == "and" else (p,))]
        return flat[0] if len(flat) == 1 and isinstance(flat[0], Node) else Node("and", tuple(flat))

    def term(depth: int):
        nonlocal at
        if depth > MOST_DEPTH:
            raise SearchError("too-deep")
        w = word()
        if w is None:
            raise SearchError("missing-operand")
        at += 1
        if is_op(w, "NOT"):
            return Node("not", (term(depth + 1),))
        if w == "(":
            inner = either(depth + 1)
            if word() != ")":
                raise SearchError("unclosed-group")
            at += 1
            return inner
        fold = True
        if w.startswith("case:"):
            w, fold = w[5:], False
            if not w:
                raise SearchError("empty-case")
        if re.search(r"\s(?:AND|OR|NOT)\s", w) and not w.startswith(("text:", "content:", "grep:", "re:")):
            raise SearchError("embedded-operator", w)
        return parse_atom(w, fold)

    if not args:
        return Node("and", ())
    out = either(0)
    if at < len(args):
        raise SearchError("unopened-group" if args[at] == ")" else "trailing", args[at])
    return out if isinstance(out, Node) else Node("and", (out,))


CONTENT = ("text", "grep")


def search(entries: DataFrame, documents: DataFrame | None, args: list[str], now: int, scope: str | None = None, truths: dict[Atom, DataFrame] | None = None, limit: int | None = None) -> DataFrame:
    """The entries (dirs, files and symlinks, no roots) for which the query holds, with
    offset: the byte offset of the first match where the query is one ``grep:`` atom.

    ``documents`` (doc_id, text) answers content atoms. ``truths`` may give an atom's
    answer from an index as (doc_id, truth): true, false or null for maybe; only maybes
    are verified against the text.
    """
    tree = parse(args)
    rows = entries.filter(F.col("kind").isin("dir", "file", "symlink") & (F.col("depth") > 0))
    if scope is not None:
        rows = rows.filter((F.col("path") == scope) | F.col("path").startswith(scope.rstrip("/") + "/"))
    content = [a for a in dict.fromkeys(tree.atoms()) if a.kind in CONTENT]
    plain = lambda a: a.test(F.col, now)
    if content:
        # conjuncts that need no content come first: they reach the scan of the entries
        for child in tree.children if tree.op == "and" else ():
            own = child.atoms() if isinstance(child, Node) else [child]
            if not any(a.kind in CONTENT for a in own):
                rows = rows.filter(child.test(plain) if isinstance(child, Node) else plain(child))
        rows = _with_content(rows, documents, content, truths or {})
        names = {a: f"__t{k}" for k, a in enumerate(content)}
        verdict = tree.test(lambda a: F.col(names[a]) if a in names else plain(a))
        verified = tree.test(lambda a: F.coalesce(F.col(names[a]), F.coalesce(a.test(F.col, now), F.lit(False))) if a in names else plain(a))
        rows = rows.filter(F.coalesce(verdict, verified))
    else:
        rows = rows.filter(tree.test(plain)) if tree.children else rows
    offset = F.lit(None).cast("long")
    if len(tree.children) and [a.kind for a in content] == ["grep"]:
        pattern = "(?m)" + content[0].value
        position = F.regexp_instr("text", F.lit(pattern))
        offset = F.when(position > 0, byte_offset(F.col("text"), position).cast("long"))
    out = [F.col("path"), F.col("kind").alias("type"), F.col("size"), F.col("mtime_s").alias("mtime"), F.col("doc_id").alias("doc"), offset.alias("offset")]
    if limit is not None:
        # the first in name order; the planner keeps the best of each partition only
        return rows.orderBy(*name_order()).limit(limit).select(*out)
    return rows.select(*out)


def name_order() -> list[Column]:
    """Directories breadth-first, names by their bytes within."""
    parent = F.regexp_replace("path", "/[^/]*$", "")
    return [F.col("depth"), F.encode(parent, "UTF-8"), F.encode("name", "UTF-8")]


def _with_content(rows: DataFrame, documents: DataFrame, atoms: list[Atom], truths: dict[Atom, DataFrame]) -> DataFrame:
    """Join the texts and one truth column for each content atom (null: verify)."""
    rows = rows.join(documents.select("doc_id", "text"), "doc_id", "left")
    for k, atom in enumerate(atoms):
        name = f"__t{k}"
        if atom in truths:
            answer = truths[atom].select("doc_id", F.col("truth").alias(name), F.lit(True).alias("__has"))
            rows = rows.join(answer, "doc_id", "left").withColumn(name, F.when(F.col("__has").isNull(), F.lit(False)).otherwise(F.col(name))).drop("__has")
        else:
            rows = rows.withColumn(name, F.when(F.col("doc_id").isNull(), F.lit(False)).otherwise(F.lit(None).cast("boolean")))
    return rows


def search_json(found: DataFrame) -> DataFrame:
    """One JSON row a result; fields without a value are left out."""
    return found.select(F.to_json(F.struct("path", "type", "size", "mtime", "doc", "offset")).alias("value"))
