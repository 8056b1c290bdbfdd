"""The line-search language: arguments to a plan, lines, matches, context and events.

Lines are exploded only from documents that a document-level test lets through, and
everything per line is a column. Only two things need Python: spans of patterns that can
match the empty string (their iteration differs from Java's) and multiline matches.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwood.functions import patterns as P
from siftwood.functions.text import strip_bom
from siftwood.plans.trigram import required_literal

SHORT = {
    "n": "line-number", "N": "no-line-number", "i": "ignore-case", "s": "case-sensitive", "S": "smart-case", "F": "fixed-strings", "w": "word-regexp", "x": "line-regexp", "v": "invert-match", "o": "only-matching",
    "c": "count", "l": "files-with-matches", "q": "quiet", "m": "max-count", "A": "after-context", "B": "before-context", "C": "context", "r": "replace", "U": "multiline", "M": "max-columns", "e": "regexp", "f": "file",
    "g": "glob", "t": "type", "T": "type-not", "a": "text", "u": "unrestricted", "L": "follow", "H": "with-filename", "I": "no-filename", "0": "null", "p": "pretty", ".": "hidden", "d": "max-depth",
}
VALUED = {"max-count", "after-context", "before-context", "context", "replace", "max-columns", "regexp", "file", "glob", "type", "type-not", "max-depth", "sort", "sortr", "color"}
SWITCHES = set(SHORT.values()) - VALUED | {"count-matches", "files-without-match", "include-zero", "multiline-dotall", "json", "stats", "files", "no-ignore", "heading", "no-heading", "live", "rg"}
REFUSED = {"pcre2", "search-zip", "pre", "encoding", "engine", "null-data", "passthru", "vimgrep", "trim", "column", "byte-offset", "crlf", "iglob", "type-add", "type-list", "replace-all", "mmap", "threads", "debug", "field-match-separator", "hyperlink-format", "stop-on-nonmatch", "binary"}


class GrepError(ValueError):
    """Arguments that are refused; an outside tool may know them."""


@dataclass
class Plan:
    patterns: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    case: str = "s"
    boundary: str = ""
    fixed: bool = False
    flags: set[str] = field(default_factory=set)
    values: dict[str, object] = field(default_factory=dict)
    globs: list[str] = field(default_factory=list)
    types: list[tuple[bool, str]] = field(default_factory=list)

    def has(self, flag: str) -> bool:
        return flag in self.flags

    @property
    def context(self) -> tuple[int, int]:
        both = self.values.get("context", 0)
        return self.values.get("before-context", both), self.values.get("after-context", both)

    @property
    def folds(self) -> bool:
        if self.case == "S":
            # literals of all patterns count, classes and escapes don't
            bare = "".join(p if self.fixed else re.sub(r"\\.|\[[^\]]*\]|\(\?[^):]*[:)]", "", p) for p in self.patterns)
            return bare == bare.lower() and any(c.isalpha() for c in bare)
        return self.case == "i"

    @property
    def regex(self) -> str:
        """One Java regex for a line (or, with -U, for a text)."""
        parts = []
        for p in self.patterns:
            body = P.quote(p) if self.fixed else re.sub(r"\(\?P<", "(?<", p)
            if self.boundary == "w":
                body = rf"(?<!\w)(?:{body})(?!\w)"
            elif self.boundary == "x":
                body = f"^(?:{body})$"
            parts.append(body)
        body = parts[0] if len(parts) == 1 else "|".join(f"(?:{p})" for p in parts)
        flags = "d" + ("iu" if self.folds else "") + ("U" if re.search(r"\\[wWbBdDsS]|\(\?<!\\w", body) and not body.isascii() else "")
        if self.has("multiline"):
            flags += "m" + ("s" if self.has("multiline-dotall") else "")
        return f"(?{flags}){body}"

    @property
    def python(self) -> re.Pattern:
        body = re.sub(r"^\(\?[a-zA-Z]+\)", "", self.regex).replace("(?<", "(?P<").replace("(?P<!", "(?<!").replace("(?P<=", "(?<=")
        flags = re.MULTILINE if self.has("multiline") else 0
        return re.compile(body, flags | (re.IGNORECASE if self.folds else 0) | (re.DOTALL if self.has("multiline-dotall") else 0))

    @property
    def may_be_empty(self) -> bool:
        try:
            return self.python.search("") is not None or any(re.search(r"[*?|]|\{0|\{,|\^|\$|\\b", p) for p in self.patterns if not self.fixed)
        except re.error:
            return True

    @property
    def every_document(self) -> bool:
        """Whether documents without a match matter to the result."""
        return self.has("invert-match") or self.has("include-zero") or self.has("files-without-match")


def parse(args: list[str], read_file=None) -> Plan:
    """``read_file`` gives the lines of a -f file; the first bare argument is the pattern
    unless -e or -f gave one."""
    plan, bare, at, explicit = Plan(), [], 0, False

    def value(name: str, inline: str | None) -> str:
        nonlocal at
        if inline is not None:
            return inline
        if at >= len(args):
            raise GrepError(f"missing value for {name}")
        at += 1
        return args[at - 1]

    def apply(name: str, inline: str | None) -> None:
        nonlocal explicit
        if name in REFUSED:
            raise GrepError(f"--{name} is not supported")
        if name in VALUED:
            v = value(name, inline)
            if name == "regexp":
                plan.patterns.append(v)
                explicit = True
            elif name == "file":
                if read_file is None:
                    raise GrepError("no reader for pattern files")
                plan.patterns += [line.removesuffix("\r") for line in read_file(v)]
                explicit = True
            elif name == "glob":
                plan.globs.append(v)
            elif name in ("type", "type-not"):
                plan.types.append((name == "type", v))
            elif name in ("replace", "color", "sort", "sortr"):
                if name in ("sort", "sortr") and v not in ("modified", "none"):
                    raise GrepError(f"--{name} {v} is not supported")
                plan.values[name] = v
            else:
                if not v.isdigit():
                    raise GrepError(f"--{name} needs a number")
                plan.values[name] = int(v)
        elif name in SWITCHES:
            if inline is not None:
                raise GrepError(f"--{name} takes no value")
            if name in ("ignore-case", "case-sensitive", "smart-case"):
                plan.case = {"ignore-case": "i", "case-sensitive": "s", "smart-case": "S"}[name]
            elif name in ("word-regexp", "line-regexp"):
                plan.boundary = name[0] if name[0] == "w" else "x"
            elif name == "fixed-strings":
                plan.fixed = True
            else:
                plan.flags.add(name)
        else:
            raise GrepError(f"unknown flag --{name}")

    while at < len(args):
        word = args[at]
        at += 1
        if word == "--":
            bare += args[at:]
            break
        if word.startswith("--"):
            name, eq, inline = word[2:].partition("=")
            apply(name, inline if eq else None)
        elif word.startswith("-") and len(word) > 1:
            rest = word[1:]
            while rest:
                letter, rest = rest[0], rest[1:]
                if letter not in SHORT:
                    raise GrepError(f"unknown flag -{letter}")
                name = SHORT[letter]
                if name in VALUED:
                    apply(name, rest.removeprefix("=") if rest else None)
                    rest = ""
                else:
                    apply(name, None)
        else:
            bare.append(word)
    if not explicit and not plan.has("files"):
        if not bare:
            raise GrepError("no pattern")
        plan.patterns.append(bare.pop(0))
    plan.paths = bare
    try:
        if plan.patterns:
            _ = plan.python
    except re.error as e:
        raise GrepError(f"bad pattern: {e}") from e
    return plan


# ── lines ──


def lines_of(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """The key columns, line_no (from 1), line. A final LF makes no further line."""
    clean = strip_bom(F.col(text))
    pieces = F.split(clean, "\n", -1)
    pieces = F.when(F.length(clean) == 0, F.array().cast("array<string>")).when(clean.endswith("\n"), F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)
    return docs.select(*key, F.posexplode(pieces).alias("pos", "line")).select(*key, (F.col("pos") + 1).alias("line_no"), "line")


def _candidates(docs: DataFrame, plan: Plan, text: str) -> DataFrame:
    """Documents that may hold a match: the line's regex in multiline mode over the whole
    text finds at least what it finds line by line, unless it anchors to the text."""
    docs = docs.filter(F.col(text).isNotNull())
    if plan.every_document or any(x in p for p in plan.patterns for x in (r"\A", r"\z", r"\Z", r"(?!", r"(?<")) and not plan.fixed:
        return docs
    if plan.fixed and not plan.folds and not plan.boundary:
        test = F.lit(False)
        for p in plan.patterns:
            test = test | F.col(text).contains(p)
        return docs.filter(test)
    # a literal that every match holds is looked for before the regex runs
    literals = [] if plan.folds or plan.fixed or any("(?" in p for p in plan.patterns) else [required_literal(p) for p in plan.patterns]
    if literals and all(literals):
        test = F.lit(False)
        for literal in literals:
            test = test | F.col(text).contains(literal)
        docs = docs.filter(test)
    return docs.filter(strip_bom(F.col(text)).rlike("(?m)" + plan.regex))


def matched_lines(docs: DataFrame, plan: Plan, key: list[str], text: str = "text") -> DataFrame:
    """Key, line_no, line, hit (whether the line is selected) of the candidates' lines."""
    rows = lines_of(_stopped(_candidates(docs, plan, text), plan, text), key, text)
    hit = F.col("line").rlike(plan.regex)
    return rows.withColumn("hit", ~hit if plan.has("invert-match") else hit)


def _stopped(docs: DataFrame, plan: Plan, text: str) -> DataFrame:
    """Without -a, documents with a NUL are binary and give no lines."""
    return docs if plan.has("text") else docs.filter(~F.col(text).contains("\x00"))


def binary_documents(docs: DataFrame, plan: Plan, key: list[str], text: str = "text") -> DataFrame:
    """Binary documents with a match before their first NUL, with the warning to print."""
    nul = F.instr(text, "\x00")
    rows = docs.filter((nul > 0) & F.substring_index(text, "\x00", 1).rlike("(?m)" + plan.regex))
    return rows.select(*key, F.format_string('binary file matches (found "\\0" byte around offset %d)', F.octet_length(F.substring_index(text, "\x00", 1)).cast("long")).alias("message"))


def selected(docs: DataFrame, plan: Plan, key: list[str], text: str = "text") -> DataFrame:
    """The selected lines, at most -m of each document."""
    rows = matched_lines(docs, plan, key, text).filter("hit").drop("hit")
    most = plan.values.get("max-count")
    if most is None:
        return rows
    w = W.partitionBy(*key).orderBy("line_no")
    return rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most).drop("__n")


def grep(docs: DataFrame, plan: Plan, key: list[str], text: str = "text") -> DataFrame:
    """Selected lines with -M, -r applied: key, line_no, line."""
    rows = selected(docs, plan, key, text)
    if "replace" in plan.values:
        rows = rows.withColumn("line", F.regexp_replace("line", F.lit(plan.regex), F.lit(java_template(plan))))
    if plan.values.get("max-columns"):
        limit = plan.values["max-columns"]
        rows = rows.withColumn("line", F.when(F.octet_length("line") > limit, "[Omitted long matching line]").otherwise(F.col("line")))
    return rows


def only_matching(docs: DataFrame, plan: Plan, key: list[str], text: str = "text") -> DataFrame:
    """-o: key, line_no, number, match of the spans that aren't empty (with -r, replaced)."""
    rows = selected(docs, plan, key, text)
    if "replace" in plan.values:
        # the marks are noncharacters, which no text exchanges
        marked = F.regexp_replace("line", F.lit(plan.regex), F.lit("\ufdd0" + java_template(plan) + "\ufdd1"))
        found = F.regexp_extract_all(marked, F.lit("\ufdd0([^\ufdd0\ufdd1]*)\ufdd1"), F.lit(1))
    else:
        found = F.filter(F.regexp_extract_all("line", F.lit(plan.regex), F.lit(0)), lambda m: m != "")
    return rows.select(*key, "line_no", F.posexplode(found).alias("number", "match"))


def one_input(spark, content: bytes, name: str = "<stdin>") -> DataFrame:
    """A single input, as from a pipe: path, text (what is no UTF-8 becomes U+FFFD)."""
    return spark.createDataFrame([(name, content.decode("utf-8", "replace"))], "path string, text string")


def presented(found: DataFrame, plan: Plan, path: str = "path") -> DataFrame:
    """path, line_no, record: lines as they are printed. -H puts the path before each, -0
    a NUL behind it, -n the number; --heading leaves the path to a record of its own."""
    parts = []
    if plan.has("with-filename") and not plan.has("no-filename") and not plan.has("heading"):
        parts.append(F.concat(F.col(path), F.decode(F.unhex(F.lit("00")), "UTF-8") if plan.has("null") else F.lit(":")))
    if plan.has("line-number") or plan.has("pretty"):
        parts.append(F.concat(F.col("line_no").cast("string"), F.lit(":")))
    rows = found.select(path, "line_no", F.concat(*parts, F.col("line")).alias("record"))
    if plan.has("heading") or plan.has("pretty"):
        rows = rows.unionByName(found.select(path).distinct().select(path, F.lit(0).alias("line_no"), F.col(path).alias("record")))
    return rows


def count_lines(docs: DataFrame, plan: Plan, key: list[str], text: str = "text") -> DataFrame:
    """-c: key, n; documents without a selected line only with --include-zero."""
    rows = selected(docs, plan, key, text).groupBy(*key).agg(F.count("*").alias("n"))
    return _with_zeros(docs, rows, plan, key)


def count_matches(docs: DataFrame, plan: Plan, key: list[str], text: str = "text") -> DataFrame:
    """--count-matches: spans, empty ones included."""
    rows = selected(docs, plan, key, text)
    n = span_counts(plan)(F.col("line")) if plan.may_be_empty else F.regexp_count("line", F.lit(plan.regex))
    return _with_zeros(docs, rows.groupBy(*key).agg(F.sum(n).cast("long").alias("n")), plan, key)


def _with_zeros(docs: DataFrame, counts: DataFrame, plan: Plan, key: list[str]) -> DataFrame:
    if not plan.has("include-zero"):
        return counts.filter("n > 0")
    return docs.select(*key).join(counts, key, "left").select(*key, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def files_with(docs: DataFrame, plan: Plan, key: list[str], text: str = "text") -> DataFrame:
    """-l. A document's test needs no explode: one line must match (or, with -v, not)."""
    if plan.has("invert-match"):
        return matched_lines(docs, plan, key, text).filter("hit").select(*key).distinct()
    pieces = F.split(strip_bom(F.col(text)), "\n", -1)
    return _stopped(_candidates(docs, plan, text), plan, text).filter(F.exists(pieces, lambda x: x.rlike(plan.regex))).select(*key)


def files_without(docs: DataFrame, plan: Plan, key: list[str], text: str = "text") -> DataFrame:
    """--files-without-match: the complement, empty documents included."""
    return docs.select(*key).join(files_with(docs, plan, key, text), key, "left_anti")


def exists(docs: DataFrame, plan: Plan, key: list[str], text: str = "text") -> bool:
    """-q."""
    return not files_with(docs, plan, key, text).limit(1).isEmpty()


def with_context(docs: DataFrame, plan: Plan, key: list[str], text: str = "text") -> DataFrame:
    """Selected lines and their context, each line once: key, line_no, line, selected,
    island (windows that touch are one island). Lines behind the -m th selected one are
    context only."""
    before, after = plan.context
    w = W.partitionBy(*key).orderBy("line_no")
    rows = matched_lines(docs, plan, key, text)
    most = plan.values.get("max-count")
    if most is not None:
        seen = F.sum(F.col("hit").cast("int")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
        rows = rows.withColumn("hit", F.col("hit") & (seen <= most))
    near = F.max(F.col("hit")).over(w.rowsBetween(-after, before))
    rows = rows.withColumn("__near", near).filter("__near")
    fresh = F.coalesce(F.col("line_no") - F.lag("line_no").over(w) > 1, F.lit(True))
    island = F.sum(fresh.cast("int")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.select(*key, "line_no", "line", F.col("hit").alias("selected"), island.alias("island"))


# ── replacement templates ──


def java_template(plan: Plan) -> str:
    """-r's template in Java's replacement language. Names are greedy, so ``$1X`` asks for
    a group called 1X; unknown groups are empty, ``$$`` and a bare ``$`` are literal."""
    groups = plan.python
    template, out, i = plan.values["replace"], "", 0
    while i < len(template):
        if template[i] == "$":
            if template.startswith("$$", i):
                out, i = out + r"\$", i + 2
                continue
            m = re.compile(r"\$(?:\{([^}]*)\}|([A-Za-z0-9_]+))").match(template, i)
            if m:
                name = m[1] if m[1] is not None else m[2]
                if name.isdigit() and int(name) <= groups.groups:
                    out += f"$0{''}" if int(name) == 0 else "${g}".replace("{g}", name) + ""
                    # a digit behind the number would be read with it
                    rest = template[m.end() : m.end() + 1]
                    out += "\\" + rest if rest.isdigit() else ""
                    i = m.end() + (1 if rest.isdigit() else 0)
                    continue
                if name in groups.groupindex:
                    out += "${" + name + "}"
                i = m.end()
                continue
            out, i = out + r"\$", i + 1
            continue
        out += "\\\\" if template[i] == "\\" else template[i]
        i += 1
    return out


# ── spans in Python ──


def spans(pattern: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    """Leftmost spans; an empty one directly behind the match before does not count."""
    last = -1
    for m in pattern.finditer(text):
        if m.end() == m.start() == last:
            continue
        last = m.end()
        yield m.start(), m.end()


def span_counts(plan: Plan):
    """Arrow UDF: how many matches a line has. None of them is kept."""
    pattern = plan.python

    @F.arrow_udf("long")
    def run(lines: pa.Array) -> pa.Array:
        return pa.array([sum(1 for _ in spans(pattern, x.as_py())) for x in lines], pa.int64())

    return run


def line_spans(plan: Plan):
    """Arrow UDF: byte spans (start, end) of a line's matches, eight bytes each."""
    pattern = plan.python

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def run(lines: pa.Array) -> pa.Array:
        starts, ends, offsets = array("i"), array("i"), array("i", [0])
        for line in lines:
            line = line.as_py()
            plain, at, before = line.isascii(), 0, 0
            for a, b in spans(pattern, line):
                if not plain:
                    # spans come in order: a text is encoded once from match to match
                    before, at, size = before + len(line[at:a].encode()), b, len(line[a:b].encode())
                    a, b = before, before + size
                    before = b
                starts.append(a)
                ends.append(b)
            offsets.append(len(starts))
        starts, ends, offsets = (pa.Array.from_buffers(pa.int32(), len(x), [None, pa.py_buffer(x)]) for x in (starts, ends, offsets))
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([starts, ends], names=["start", "end"]))

    return run


def multiline(docs: DataFrame, plan: Plan, key: str = "doc_id", text: str = "text") -> DataFrame:
    """-U: key, first_line, last_line, start, end (bytes) of each group of lines that
    matches share, with n_matches; -m limits the groups."""
    pattern, most = plan.python, plan.values.get("max-count")

    def groups(value: str) -> list[list[int]]:
        out: list[list[int]] = []
        for a, b in spans(pattern, value):
            if a == len(value) and (not value or value.endswith("\n")):
                continue
            first = value.count("\n", 0, a) + 1
            last = max(first, value.count("\n", 0, b - 1 if b > a and value[b - 1] == "\n" else b) + 1)
            if out and first <= out[-1][1]:
                out[-1][1], out[-1][3], out[-1][4] = max(last, out[-1][1]), b, out[-1][4] + 1
            else:
                out.append([first, last, a, b, 1])
        return out if most is None else out[:most]

    def run(batches):
        for batch in batches:
            rows = []
            for k, value in zip(batch.column(key).to_pylist(), batch.column(text).to_pylist(), strict=True):
                for first, last, a, b, n in groups(value.removeprefix("\ufeff")):
                    rows.append((k, first, last, len(value[:a].encode()), len(value[:b].encode()), n))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [batch.schema.field(key).type, *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[key, "first_line", "last_line", "start", "end", "n_matches"])

    kind = dict(docs.dtypes)[key]
    rows = _stopped(docs.filter(F.col(text).rlike(plan.regex)), plan, text).select(key, text)
    return rows.mapInArrow(run, f"{key} {kind}, first_line long, last_line long, start long, end long, n_matches long")


# ── events and statistics ──


def json_events(docs: DataFrame, plan: Plan, path: str = "path", text: str = "text") -> DataFrame:
    """begin, match, context and end events as JSON rows, ordered by path and seq."""
    rows = with_context(docs, plan, [path], text)
    rows = rows.join(docs.select(path, F.col(text).alias("__text")), path)
    pieces = F.split(strip_bom(F.col("__text")), "\n", -1)
    offset = F.when(F.col("line_no") == 1, 0).otherwise(F.octet_length(F.array_join(F.slice(pieces, 1, F.col("line_no") - 1), "\n")) + 1)
    found = F.when(F.col("selected"), line_spans(plan)(F.col("line")))
    sub = F.transform(found, lambda s: F.struct(F.struct(F.decode(F.substr(F.encode("line", "UTF-8"), s["start"] + 1, s["end"] - s["start"]), "UTF-8").alias("text")).alias("match"), s["start"].alias("start"), s["end"].alias("end")))
    where = F.struct(F.col(path).alias("text")).alias("path")
    full = F.concat("line", F.when((F.col("line_no") < F.size(pieces)), "\n").otherwise(""))
    data = F.struct(where, F.struct(full.alias("text")).alias("lines"), F.col("line_no").alias("line_number"), offset.cast("long").alias("absolute_offset"), F.coalesce(sub, F.array().cast("array<struct<match:struct<text:string>,start:int,end:int>>")).alias("submatches"))
    body = rows.select(path, F.col("line_no").alias("seq"), F.to_json(F.struct(F.when(F.col("selected"), "match").otherwise("context").alias("type"), data.alias("data"))).alias("value"))
    files = rows.filter("selected").select(path).distinct()
    begin = files.select(path, F.lit(0).alias("seq"), F.to_json(F.struct(F.lit("begin").alias("type"), F.struct(where).alias("data"))).alias("value"))
    end = files.select(path, F.lit(2**31 - 1).alias("seq"), F.to_json(F.struct(F.lit("end").alias("type"), F.struct(where).alias("data"))).alias("value"))
    return begin.unionByName(body).unionByName(end)


def summary(docs: DataFrame, plan: Plan, key: list[str], text: str = "text") -> DataFrame:
    """searches, searches_with_match, matched_lines, matches, bytes_searched."""
    per = selected(docs, plan, key, text).groupBy(*key).agg(F.count("*").alias("lines"), F.sum(F.regexp_count("line", F.lit(plan.regex))).alias("matches"))
    rows = docs.select(*key, F.octet_length(text).cast("long").alias("bytes")).join(per, key, "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.agg(F.count("*").alias("searches"), F.count("lines").alias("searches_with_match"), total("lines").alias("matched_lines"), total("matches").alias("matches"), total("bytes").alias("bytes_searched"))


# ── selection of files ──


def expand_braces(glob: str) -> list[str]:
    m = re.search(r"\{([^{}]*)\}", glob)
    return [glob] if not m else [x for part in m[1].split(",") for x in expand_braces(glob[: m.start()] + part + glob[m.end() :])]


def glob_regex(glob: str) -> str:
    """-g's glob: without a slash it holds for a basename, else for the path below the root."""
    parts = []
    for g in expand_braces(glob):
        rooted = "/" in g.rstrip("/")
        body = P.search_glob("/" + g.lstrip("/") if rooted else g, fold=False)
        parts.append(re.sub(r"^\(\?s\)\^|\$$", "", body) if rooted else "(?:.*/)?" + re.sub(r"^\(\?s\)\^|\$$", "", body))
    return "(?s)^(?:" + "|".join(f"(?:{p})" for p in parts) + ")$"


def glob_selected(path: Column, globs: list[str]) -> Column:
    """Ordered overrides over a path below the root (with a leading slash); the last that
    holds decides, ``!`` negates. With a positive glob, unmatched files are out."""
    positive = any(not g.startswith("!") for g in globs)
    out = F.lit(not positive)
    for g in globs:
        negate = g.startswith("!")
        out = F.when(path.rlike(glob_regex(g[1:] if negate else g)), F.lit(not negate)).otherwise(out)
    return out


#: File types by extension lists; names in capitals or with a dot inside are whole names.
TYPES = {
    "ada": "adb ads", "asm": "asm s S", "awk": "awk", "bazel": "bazel bzl BUILD WORKSPACE", "c": "c h H cats", "clojure": "clj cljc cljs cljx", "cmake": "cmake CMakeLists.txt", "config": "cfg conf config ini", "cpp": "cpp cc cxx hpp hh hxx inl C",
    "crystal": "cr ecr", "cs": "cs", "css": "css scss", "csv": "csv", "cuda": "cu cuh", "cython": "pyx pxd pxi", "d": "d", "dart": "dart", "diff": "diff patch", "docker": "Dockerfile dockerfile", "elisp": "el", "elixir": "ex exs eex heex", "elm": "elm",
    "erlang": "erl hrl", "fish": "fish", "fortran": "f f77 f90 f95 F F90", "fsharp": "fs fsi fsx", "gn": "gn gni", "go": "go", "gradle": "gradle", "graphql": "graphql graphqls", "groovy": "groovy gradle", "h": "h hpp hh", "haskell": "hs lhs cpphs", "html": "html htm ejs",
    "java": "java jsp jspx properties", "js": "js jsx mjs cjs vue", "json": "json sarif", "jsonl": "jsonl", "julia": "jl", "jupyter": "ipynb jpynb", "kotlin": "kt kts", "less": "less", "lisp": "lisp el jl sc scm", "log": "log", "lua": "lua", "make": "mk mak Makefile makefile GNUmakefile",
    "man": "1 2 3 4 5 6 7 8", "markdown": "md markdown mdx mkd", "matlab": "m", "md": "md markdown mdx mkd", "nim": "nim nims nimble", "nix": "nix", "objc": "m h", "ocaml": "ml mli mll mly", "org": "org org_archive", "pascal": "pas pp lpr inc dpr", "pdf": "pdf", "perl": "pl pm t perl plx",
    "php": "php php3 php4 php5 phtml", "prolog": "pl pro prolog P", "protobuf": "proto", "puppet": "epp erb pp rb", "purs": "purs", "py": "py pyi", "r": "r R Rmd Rnw", "racket": "rkt", "rst": "rst", "ruby": "rb rbw gemspec Gemfile Rakefile", "rust": "rs", "sass": "sass scss", "scala": "scala sbt",
    "sh": "sh bash zsh ksh csh tcsh", "sql": "sql psql", "svelte": "svelte", "svg": "svg", "swift": "swift", "systemd": "service socket timer target mount", "tcl": "tcl", "tex": "tex ltx cls sty bib dtx ins", "tf": "tf tfvars", "toml": "toml Cargo.lock", "ts": "ts tsx cts mts", "txt": "txt",
    "agda": "agda lagda", "alloy": "als", "amake": "bp mk", "asciidoc": "adoc asc asciidoc", "ats": "ats dats sats hats", "avro": "avdl avpr avsc", "bat": "bat", "batch": "bat", "bitbake": "bb bbappend bbclass conf inc", "boxlang": "bx bxm bxs", "brotli": "br", "buildstream": "bst",
    "bzip2": "bz2 tbz2", "cabal": "cabal", "candid": "did", "carp": "carp", "cbor": "cbor", "ceylon": "ceylon", "cfml": "cfc cfm", "cml": "cml", "coffeescript": "coffee", "coq": "v", "creole": "creole", "csharp": "cs", "cshtml": "cshtml", "csproj": "csproj", "devicetree": "dts dtsi", "dhall": "dhall",
    "dita": "dita ditamap ditaval", "dts": "dts dtsi", "dvc": "Dvcfile dvc", "ebuild": "ebuild eclass", "edn": "edn", "erb": "erb", "fennel": "fnl", "fidl": "fidl", "flatbuffers": "fbs", "gap": "g gap gi gd tst", "gdscript": "gd", "gleam": "gleam", "gprbuild": "gpr", "gzip": "gz tgz", "haml": "haml", "hare": "ha",
    "hbs": "hbs", "hs": "hs lhs", "hy": "hy", "idris": "idr lidr", "janet": "janet", "jinja": "j2 jinja jinja2", "jl": "jl", "k": "k", "lean": "lean", "lilypond": "ly ily", "llvm": "ll", "lock": "lock", "lz4": "lz4", "lzma": "lzma", "m4": "ac m4", "mako": "mako mao", "meson": "meson.build meson_options.txt", "minified": "min.html min.css min.js",
    "mint": "mint", "mk": "mkfile", "ml": "ml", "motoko": "mo", "msbuild": "csproj fsproj vcxproj proj props targets sln", "objcpp": "h mm", "pdl": "pdl", "pod": "pod", "postscript": "eps ps", "prql": "prql", "ps": "cdxml ps1 ps1xml psd1 psm1", "puppet5": "epp pp", "purescript": "purs", "python": "py pyi", "qmake": "pro pri prf", "qml": "qml", "qrc": "qrc", "qui": "ui",
    "raku": "raku rakumod rakudoc rakutest p6 pl6 pm6", "rdoc": "rdoc", "reasonml": "re rei", "red": "r red reds", "rescript": "res resi", "robot": "robot", "seed7": "sd7 s7i", "slim": "skim slim slime", "smarty": "tpl", "sml": "sml sig", "solidity": "sol", "soy": "soy", "spark": "spark", "spec": "spec", "stylus": "styl", "sv": "v vg sv svh h", "swig": "def i", "taskpaper": "taskpaper",
    "texinfo": "texi", "textile": "textile", "thrift": "thrift", "twig": "twig", "typoscript": "typoscript ts", "typst": "typ", "usd": "usd usda usdc", "vb": "vb", "vcl": "vcl", "vimscript": "vim vimrc", "vue3": "vue", "webidl": "idl webidl widl", "wgsl": "wgsl", "wiki": "mediawiki wiki", "xz": "xz txz", "yacc": "y", "yang": "yang", "z": "Z", "zeek": "bro zeek", "zstd": "zst zstd", "container": "Containerfile Dockerfile", "csv2": "csv tsv", "nginx": "nginx nginxconf", "license": "COPYING LICENSE LICENCE NOTICE UNLICENSE", "readme": "README README.md README.txt", "just": "justfile Justfile just", "jsonnet": "jsonnet libsonnet", "terraform": "tf tfvars", "tt": "tt ttml", "ultisnips": "snippets", "aidl": "aidl", "asp": "aspx ascx asp", "astro": "astro", "c++": "cpp hpp cc hh", "d2": "d2", "graphviz": "dot gv", "groff": "me mm ms", "lhs": "lhs", "mermaid": "mmd mermaid", "nasm": "nasm", "odin": "odin", "pony": "pony", "rmd": "Rmd", "sass2": "sass", "roc": "roc", "uiua": "ua", "cairo": "cairo", "move": "move", "cue": "cue", "nu": "nu", "ex": "ex exs", "bicep": "bicep", "tsx": "tsx", "jsx": "jsx", "tsv": "tsv", "parquet": "parquet", "plist": "plist", "po": "po pot", "proto": "proto", "properties": "properties", "ini": "ini cfg", "env": "env", "diff2": "patch", "gitignore": "gitignore", "dockerignore": "dockerignore", "ipynb": "ipynb",
    "typescript": "ts tsx cts mts", "v": "v vsh", "vala": "vala", "verilog": "v vh sv svh", "vhdl": "vhd vhdl", "vim": "vim vimrc", "vue": "vue", "xml": "xml xsl xslt xsd dtd rng sch xhtml", "yaml": "yaml yml", "zig": "zig", "zsh": "zsh zshrc zshenv zprofile",
}


def type_selected(name: Column, types: list[tuple[bool, str]]) -> Column:
    """-t and -T in order over basenames; ``all`` stands for every known type."""

    def holds(kind: str) -> Column:
        if kind == "all":
            return name.rlike("(?s)" + "|".join(_type_regex(k) for k in TYPES))
        if kind not in TYPES:
            raise GrepError(f"unknown type {kind!r}")
        return name.rlike(_type_regex(kind))

    out = F.lit(not any(include for include, _ in types))
    for include, kind in types:
        out = F.when(holds(kind), F.lit(include)).otherwise(out)
    return out


def _type_regex(kind: str) -> str:
    words = TYPES[kind].split()
    whole = [w for w in words if "." in w or (len(w) > 2 and w[0].isupper()) or w in ("dockerfile", "makefile")]
    ends = [w for w in words if w not in whole]
    return "^(?:" + "|".join([*(P.quote(w) for w in whole), *([r".+\.(?:" + "|".join(map(P.quote, ends)) + ")"] if ends else [])]) + ")$"


def names(entries: DataFrame, plan: Plan) -> DataFrame:
    """--files: path, rank. Hidden names (unless --hidden or -uu) and excluded ones are
    left out; --sort modified orders by time, missing times count as newest."""
    below = F.expr("substring(path, length(root) + 1)")
    rows = entries.filter("kind = 'file'")
    if not plan.has("hidden"):
        rows = rows.filter(~below.rlike(r"/\.[^/]"))
    if plan.globs:
        rows = rows.filter(glob_selected(below, plan.globs))
    if plan.types:
        rows = rows.filter(type_selected(F.col("name"), plan.types))
    if "max-depth" in plan.values:
        rows = rows.filter(F.col("depth") <= plan.values["max-depth"])
    how = "sort" if plan.values.get("sort") == "modified" else "sortr" if plan.values.get("sortr") == "modified" else None
    rows = rows.select("path", "mtime_s", "mtime_ns")
    if how is None:
        return rows.select("path")
    newest = [F.asc_nulls_last("mtime_s"), F.asc_nulls_last("mtime_ns")] if how == "sort" else [F.desc_nulls_first("mtime_s"), F.desc_nulls_first("mtime_ns")]
    return rows.orderBy(*newest, "path").select("path")
