import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwood.functions import modes
from siftwood.functions import patterns as P
from siftwood.functions import text as T
from siftwood.functions.dates import NS, DateError, parse_date
from siftwood.operators.ignore import compile_line
from siftwood.plans import trigram


def hit(regex, text):
    # java's [\s\S] and lookaheads read the same in Python
    return re.search(re.sub(r"^\(\?([a-z]+)\)", lambda m: f"(?{m[1].replace('d', '').replace('u', '')})" if m[1].replace("d", "").replace("u", "") else "", regex), text) is not None


@pytest.mark.parametrize(("glob", "path", "expected"), [("*.rs", "a.RS", True), ("*.rs", "x/a.rs", False), ("a?c", "a/c", False), ("[!a]b", "/b", False), ("src/*.c", "/x/src/a.c", True), ("src/*.c", "/x/src/y/a.c", False), ("/a/**/c", "/a/c", True), ("/a/**/c", "/a/b/b/c", True), ("**/c", "/q/c", True)])
def test_search_glob(glob, path, expected):
    assert hit(P.search_glob(glob), path) is expected


@pytest.mark.parametrize(("glob", "name", "expected"), [("*", ".x/y", True), ("a*c", "a/b/c", True), ("[a-c]x", "bx", True), ("[!a-c]x", "bx", False), ("a\\*", "a*", True), ("a\\", "a\\", False), ("[", "[", True), ("[[:digit:]]", "5", True)])
def test_fnmatch(glob, name, expected):
    regex = P.fnmatch(glob).replace(r"\p{Digit}", "0-9")
    assert hit(regex, name) is expected


@pytest.mark.parametrize(
    ("dialect", "pattern", "text", "expected"),
    [("emacs", r".*\.\(c\|h\)", "a.h", True), ("emacs", "a+b", "aab", True), ("posix-basic", "a+b", "a+b", True), ("posix-basic", r"a\+b", "aab", True), ("posix-extended", "a{2}|b", "aa", True), ("posix-basic", r"a\{2\}", "aa", True), ("awk", "a{2}", "a{2}", True), ("posix-minimal-basic", r"a\|b", "a|b", True), ("posix-basic", "*a", "*a", True), ("posix-extended", "(a)(b)\\2", "abb", True)],
)
def test_dialects(dialect, pattern, text, expected):
    assert hit(P.gnu_regex(pattern, dialect), text) is expected


def test_dialect_errors():
    for bad in ("a\\(", "a\\)", "x\\", "[a"):
        with pytest.raises(P.PatternError):
            P.gnu_regex(bad)
    with pytest.raises(P.PatternError):
        P.gnu_regex("a", "nonesuch")


def test_modes():
    assert modes.parse_mode("4755") == 0o4755
    assert modes.parse_mode("u+w,g=r,o-x") == 0o240
    assert modes.parse_mode("a+X") == 0
    assert modes.parse_mode("a+X", directory=True) == 0o111
    assert modes.parse_mode("u+s,+t") == 0o5000
    with pytest.raises(modes.ModeError):
        modes.parse_mode("77777")
    assert modes.makedev(8, 1) == 2049


def test_dates():
    now = 1_700_000_000 * NS + 5
    assert parse_date("now", now) == now
    assert parse_date("@17", now) == 17 * NS
    assert parse_date("2 hours ago", now) == now - 7200 * NS
    assert parse_date("yesterday", now) == now - 86400 * NS
    assert parse_date("2024-01-20 12:00", now) == 1_705_752_000 * NS
    assert parse_date("2024-01-20T12:00:00+02:00", now) == 1_705_744_800 * NS
    assert parse_date("1 month ago", 1_711_800_000 * NS) // NS == 1_709_294_400
    with pytest.raises(DateError):
        parse_date("soon", now)
    with pytest.raises(DateError):
        parse_date("2024-03-31 02:30", now, "Europe/Berlin")


def test_units_and_tokens():
    assert T.py_units("parseHTTPRequest_v2") == ["parse", "HTTP", "Request", "v", "2"]
    assert T.py_units("snake_case x") == ["snake", "case", "x"]
    assert T.normalize_token("Foo_1") == "foo_1" and T.normalize_token("a b") is None
    assert T.exact_under_cap("a" * 60) and not T.exact_under_cap("a" * 61)


def test_base64_spans():
    random = "aB3dE5fG7hJ9kL1mN3pQ5rS7"
    assert T.base64_spans(f"x {random}== y") == [(2, 28)]
    for written in ("thisIsACamelCaseIdentifierName", "0123456789abcdef0123456789abcdef", "short9A"):
        assert T.base64_spans(written) == []


@pytest.mark.parametrize(("line", "path", "expected"), [("*.tmp", "a/b.tmp", True), ("/build/", "build", True), ("/build/", "x/build", False), ("docs/**/x", "docs/a/b/x", True), ("a/*", "a/b/c", False), ("!keep", "keep", True), ("\\#x", "#x", True)])
def test_ignore_lines(line, path, expected):
    assert (re.search(compile_line(line)[0], path) is not None) is expected


def test_ignore_flags():
    assert compile_line("!a/")[1:] == (True, True)
    assert compile_line("# c") is None and compile_line("") is None and compile_line("/") is None


_regex = st.recursive(st.sampled_from(["a", "b", "c", "ab", "foo", ".", "[ab]", "[a-z]", "x?"]), lambda s: st.one_of(st.tuples(s, s).map("".join), st.tuples(s, s).map(lambda t: f"(?:{t[0]}|{t[1]})"), s.map(lambda x: f"(?:{x})+"), s.map(lambda x: f"(?:{x})*"), s.map(lambda x: f"(?:{x}){{2}}")), max_leaves=8)


@settings(max_examples=300, deadline=None)
@given(_regex, st.text("abcfox", max_size=14))
def test_every_match_meets_its_trigrams(pattern, text):
    if re.search(pattern, text):
        query = trigram.derive(pattern)
        assert trigram.holds(query, lambda k: k in text)
        assert trigram.holds(trigram.weaken(query, {}), lambda k: k in text)


def test_trigram_queries():
    assert trigram.derive("a.c") == trigram.ALL
    assert trigram.keys(trigram.derive("hello")) == {"hel", "ell", "llo"}
    assert "kel" not in trigram.keys(trigram.derive("(?i)kelvin"))
    assert trigram.required_literal("foo[ab]barbaz") == "barbaz"
    assert P.glob_literal("src/*mainly?.rs") == "mainly"
