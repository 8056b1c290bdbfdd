"""Pattern languages translated to Java regular expressions.

Three glob languages are kept apart: the search grammar's (stars stop at a slash), the
find language's fnmatch (stars cross slashes and match leading dots) and the ignore
files' (in operators/ignore.py). GNU regex dialects are translated operator by operator.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_META = set(".^$*+?()[]{}|\\")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CLASSES = {"alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "space": r"\s", "blank": r"\p{Blank}", "punct": r"\p{Punct}", "print": r"\p{Print}", "graph": r"\p{Graph}", "cntrl": r"\p{Cntrl}", "xdigit": r"\p{XDigit}"}


class PatternError(ValueError):
    """A pattern that its language refuses."""


def quote(text: str) -> str:
    """A regex that matches the text itself."""
    return "".join("\\" + c if c in _META or c in "&~#-" else c for c in text)


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z and nothing else (lower() would fold all of Unicode)."""
    return F.translate(column, UPPER, LOWER)


def fold_ascii(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))


def has_glob(text: str) -> bool:
    return any(c in text for c in "*?[")


def _bracket(pattern: str, at: int, no_slash: bool, escapes: bool = True) -> tuple[str, int] | None:
    """The regex of the bracket expression at ``at`` and where it ends; None if it doesn't."""
    i, negate = at + 1, False
    if i < len(pattern) and pattern[i] in "!^":
        negate, i = True, i + 1
    body, first = "", True
    while i < len(pattern) and (pattern[i] != "]" or first):
        first = False
        if pattern.startswith("[:", i) and (end := pattern.find(":]", i + 2)) > 0:
            name = pattern[i + 2 : end]
            if name not in CLASSES:
                return None
            body, i = body + CLASSES[name], end + 2
            continue
        if escapes and pattern[i] == "\\" and i + 1 < len(pattern):
            i += 1
        c = pattern[i]
        if i + 2 < len(pattern) and pattern[i + 1] == "-" and pattern[i + 2] != "]":
            high = pattern[i + 2]
            if high == "\\" and escapes and i + 3 < len(pattern):
                i, high = i + 1, pattern[i + 3]
            if c <= high:
                body += f"{quote(c)}-{quote(high)}"
            i += 3
            continue
        body, i = body + quote(c), i + 1
    if i >= len(pattern):
        return None
    inner = f"[{'^' if negate else ''}{body}]" if body else ("[\\s\\S]" if negate else "(?!)")
    return (f"(?!/){inner}" if no_slash else inner), i + 1


def search_glob(pattern: str, fold: bool = True) -> str:
    """Regex of a search glob: a whole name, or, with a slash, trailing components (the
    whole path where it begins with a slash); ``**`` components span any depth."""
    flags = "(?si)" if fold else "(?s)"
    if "/" not in pattern:
        return f"{flags}^{_components([pattern])}$"
    rooted = pattern.startswith("/")
    parts = pattern.strip("/").split("/") if rooted else pattern.split("/")
    return f"{flags}^{'/' if rooted else '(?:.*/)?'}{_components(parts)}$"


def _components(parts: list[str]) -> str:
    out = ""
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out += ".*" if last else "(?:[^/]+/)*"
            continue
        i = 0
        while i < len(part):
            c = part[i]
            if c == "*":
                out += "[^/]*"
            elif c == "?":
                out += "[^/]"
            elif c == "[" and (found := _bracket(part, i, True)):
                out += found[0]
                i = found[1]
                continue
            elif c == "\\" and i + 1 < len(part):
                i += 1
                out += quote(part[i])
            else:
                out += quote(c)
            i += 1
        out += "" if last else "/"
    return out


def fnmatch(pattern: str, fold: bool = False) -> str:
    """Regex of the find language's glob. A trailing backslash never matches."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (found := _bracket(pattern, i, False)):
            out += found[0]
            i = found[1]
            continue
        elif c == "\\":
            if i + 1 == len(pattern):
                return "(?!)"
            i += 1
            out += quote(pattern[i])
        else:
            out += quote(c)
        i += 1
    return f"{'(?si)' if fold else '(?s)'}^{out}$"


def glob_literal(pattern: str) -> str:
    """The longest text that every match of a glob holds (maybe empty)."""
    best, run, i = "", "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i, run = i + 1, run + pattern[i + 1]
        elif c == "[" and (found := _bracket(pattern, i, False)):
            i, run = found[1] - 1, ""
        elif c in "*?" or (c == "/" and "**" in pattern):
            run = ""
        else:
            run += c
        best, i = max(best, run, key=len), i + 1
    return best


#: name: (basic, plus and question are operators "bare", "escaped" or "no", alternation, intervals, newline)
DIALECTS = {
    "emacs": "emacs", "findutils-default": "emacs", "posix-basic": "basic", "sed": "basic", "ed": "basic", "grep": "grep", "egrep": "egrep", "posix-egrep": "egrep",
    "posix-minimal-basic": "minimal", "posix-extended": "extended", "awk": "awk", "posix-awk": "posix-awk", "gnu-awk": "gnu-awk",
}


def gnu_regex(pattern: str, dialect: str = "findutils-default", fold: bool = False) -> str:
    """A GNU regex of one of the named dialects as an anchored Java regex."""
    if dialect not in DIALECTS:
        raise PatternError(f"unknown regular expression type {dialect!r}")
    kind = DIALECTS[dialect]
    basic = kind in ("emacs", "basic", "grep", "minimal")
    out, i, depth, start = "", 0, 0, True
    while i < len(pattern):
        c, escaped = pattern[i], False
        if c == "\\":
            if i + 1 == len(pattern):
                raise PatternError("trailing backslash")
            escaped, i, c = True, i + 1, pattern[i + 1]
        rest = pattern[i + 1 :]
        begins, start = start, False
        if not escaped and c == "[":
            found = _bracket(pattern, i, False, escapes=kind in ("awk", "gnu-awk", "posix-awk"))
            if found is None:
                raise PatternError("unmatched [")
            out, i = out + found[0], found[1]
            continue
        if c in "()" and escaped == basic:
            depth += 1 if c == "(" else -1
            if depth < 0:
                raise PatternError("unmatched )")
            out, start = out + c, c == "("
        elif c == "|" and (escaped == basic) and kind != "minimal":
            out, start = out + "|", True
        elif c == "\n" and kind in ("grep", "egrep"):
            out, start = out + "|", True
        elif c in "+?" and ((not escaped) if kind == "emacs" or not basic else (escaped and kind != "minimal")):
            out += quote(c) if begins and basic else ("" if begins else c)
        elif c == "{" and kind not in ("awk", "emacs") and escaped == basic:
            end = pattern.find("\\}" if basic else "}", i)
            body = pattern[i + 1 : end] if end > 0 else ""
            if body and all(p.isdigit() or p == "" for p in body.split(",")) and body != "," and not begins:
                out += "{" + ("0" if body.startswith(",") else "") + body + "}"
                i = end + (2 if basic else 1)
                continue
            out += r"\{"
        elif c == "*" and not escaped:
            out += r"\*" if begins else ("*" if not out.endswith(("*", "+", "?", "}")) or out.endswith("\\*") else "")
        elif c == "." and not escaped:
            out += "[\\s\\S]" if kind in ("emacs", "awk", "gnu-awk", "posix-awk") or basic else "[\\s\\S]"
        elif c == "^" and not escaped:
            anchor = not basic or begins
            out, start = out + ("^" if anchor else r"\^"), anchor
        elif c == "$" and not escaped:
            ends = not basic or not rest or rest.startswith(("\\)", "\\|")) or (kind == "grep" and rest.startswith("\n"))
            out += "$" if ends else r"\$"
        elif escaped and c in "`'" and kind not in ("awk", "posix-awk"):
            out += r"\A" if c == "`" else r"\z"
        elif escaped and c in "wWsSbB" and kind not in ("awk", "posix-awk"):
            out += "\\" + c
        elif escaped and c in "<>" and kind not in ("awk", "posix-awk"):
            out += r"\b(?=\w)" if c == "<" else r"\b(?<=\w)"
        elif escaped and c.isdigit() and c != "0" and kind not in ("awk", "posix-awk", "gnu-awk"):
            out += "\\" + c
        else:
            out += quote(c)
        i += 1
    if depth:
        raise PatternError("unmatched (")
    return f"{'(?i)' if fold else ''}^(?:{out})$"
