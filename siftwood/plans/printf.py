"""printf formats of the find language as string columns, and the -ls line."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwood.functions import modes
from siftwood.functions.dates import time_code, whole_time

_ESCAPES = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\\": "\\"}
_DIRECTIVE = re.compile(r"%([-+ #0]*)(\d*)(?:\.(\d*))?([ABCT].|.)", re.S)


class FormatError(ValueError):
    """A format that the language refuses."""


def _stamp(letter: str) -> tuple[Column, Column]:
    name = {"A": "atime", "B": "mtime", "C": "ctime", "T": "mtime", "a": "atime", "c": "ctime", "t": "mtime"}[letter]
    return F.col(f"{name}_s"), F.col(f"{name}_ns")


def general(value: Column) -> Column:
    """C's %g of a double (six significant digits)."""
    exponent = F.when(value == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(value)))).cast("int")
    plain = F.lit("")
    for e in range(-4, 6):
        plain = F.when(exponent == e, F.format_string(f"%.{5 - e}f", value)).otherwise(plain)
    plain = F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    scientific = F.regexp_replace(F.regexp_replace(F.format_string("%.5e", value), r"(\.\d*?)0+e", "$1e"), r"\.e", "e")
    return F.when(exponent.between(-4, 5), plain).otherwise(scientific)


def blocks() -> Column:
    """512-byte blocks: the size in whole kibibytes, as far as a catalog can know."""
    return F.ceil(F.col("size") / 1024) * 2


def directive(code: str, flags: str = "") -> Column:
    """The value of one directive over the columns of an entry."""
    path, root = F.col("path"), F.col("root")
    if code == "p":
        return path
    if code == "P":
        return F.when(path == root, "").otherwise(F.expr("substring(path, length(rtrim('/', root)) + 2)"))
    if code == "H":
        return root
    if code == "f":
        return F.col("name")
    if code == "h":
        return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")
    if code == "d":
        return F.col("depth").cast("string")
    if code == "y":
        return modes.kind_letter(F.col("kind"))
    if code == "Y":
        return F.when(F.col("kind") != "symlink", modes.kind_letter(F.col("kind"))).when(F.col("follow_kind").isNull(), "N").when(F.col("follow_kind") == "loop", "L").otherwise(modes.kind_letter(F.col("follow_kind")))
    if code == "l":
        return F.coalesce("target", F.lit(""))
    if code == "F":
        return F.coalesce("fs_type", F.lit("unknown"))
    if code in "siDnUG":
        return F.col({"s": "size", "i": "ino", "D": "dev", "n": "nlink", "U": "uid", "G": "gid"}[code]).cast("string")
    if code == "m":
        return modes.octal(F.col("mode"), "#" in flags)
    if code == "M":
        return modes.letters(F.col("mode"), F.col("kind"))
    if code in "ug":
        name, number = ("user_name", "uid") if code == "u" else ("group_name", "gid")
        return F.coalesce(F.col(name), F.col(number).cast("string"))
    if code == "b":
        return blocks().cast("string")
    if code == "k":
        return F.ceil(blocks() / 2).cast("string")
    if code == "S":
        return F.when(F.col("size") == 0, "1").otherwise(general(blocks() * 512.0 / F.col("size")))
    if code in "act":
        return whole_time(*_stamp(code))
    raise FormatError(f"unknown directive %{code}")


def compile_format(text: str) -> Column:
    """A format as one column. ``\\c`` ends it."""
    parts: list[Column] = []
    literal, i = "", 0

    def flush() -> None:
        nonlocal literal
        if literal:
            parts.append(F.lit(literal))
            literal = ""

    while i < len(text):
        c = text[i]
        if c == "\\":
            if i + 1 == len(text):
                raise FormatError("trailing backslash")
            n = text[i + 1]
            if n == "c":
                break
            if m := re.match(r"[0-7]{1,3}", text[i + 1 :]):
                literal += chr(int(m[0], 8) & 255)
                i += 1 + len(m[0])
                continue
            literal += _ESCAPES.get(n, "\\" + n)
            i += 2
            continue
        if c != "%":
            literal, i = literal + c, i + 1
            continue
        if text.startswith("%%", i):
            literal, i = literal + "%", i + 2
            continue
        m = _DIRECTIVE.match(text, i)
        if not m:
            raise FormatError("format ends in %")
        flags, width, precision, code = m.groups()
        if code in "ABCT" or code == "Z":
            raise FormatError(f"%{code} is not supported")
        flush()
        value = time_code(code[1], *_stamp(code[0])) if len(code) == 2 else directive(code, flags)
        if width and int(width) > 1_000_000:
            raise FormatError("width too large")
        if precision is not None:
            value = F.substring(value, 1, int(precision or 0)) if code not in "dsinbkUGDm" else F.when(F.length(value) < int(precision or 0), F.lpad(value, int(precision or 0), "0")).otherwise(value)
        if width:
            n, numeric = int(width), code in "dsinbkUGDm"
            fill = "0" if "0" in flags and numeric and "-" not in flags and precision is None else " "
            padded = F.rpad(value, n, " ") if "-" in flags else F.lpad(value, n, fill)
            value = F.when(F.length(value) < n, padded).otherwise(value)
        parts.append(value)
        i = m.end()
    flush()
    return F.concat(*parts) if parts else F.lit("")


def escaped(text: Column) -> Column:
    """Blanks, quotes, backslashes and control characters as -ls writes them."""
    out = F.regexp_replace(text, r'([ \\"])', r"\\$1")
    for c, e in (("\n", r"\\n"), ("\t", r"\\t"), ("\r", r"\\r"), ("\b", r"\\b"), ("\f", r"\\f"), ("\x0b", r"\\v")):
        out = F.regexp_replace(out, re.escape(c) if c != "\b" else "\\x08", e)
    return out


def ls_line(now: int) -> Column:
    """The -ls record of an entry (without the newline)."""
    seconds = F.col("mtime_s")
    ts = F.timestamp_seconds(seconds)
    day = F.concat(F.date_format(ts, "MMM "), F.lpad(F.dayofmonth(ts).cast("string"), 2, " "))
    old = (seconds > now + 3600) | (seconds < now - 15_778_476)
    date = F.when(old, F.concat(day, F.lit("  "), F.date_format(ts, "yyyy"))).otherwise(F.concat(day, F.date_format(ts, " HH:mm")))

    def pad(c: Column, n: int, right: bool) -> Column:
        return F.when(F.length(c) >= n, c).otherwise(F.rpad(c, n, " ") if right else F.lpad(c, n, " "))

    user, group = directive("u"), directive("g")
    cells = [pad(F.col("ino").cast("string"), 9, False), pad(directive("k"), 6, False), modes.letters(F.col("mode"), F.col("kind")), pad(F.col("nlink").cast("string"), 3, False), pad(user, 8, True), pad(group, 8, True), pad(F.col("size").cast("string"), 8, False), date, escaped(F.col("path"))]
    line = F.concat_ws(" ", *cells)
    return F.when(F.col("kind") == "symlink", F.concat(line, F.lit(" -> "), escaped(F.coalesce("target", F.lit(""))))).otherwise(line)
