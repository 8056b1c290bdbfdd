import os

import pytest
from pyspark.sql import functions as F

from siftwood.plans import find as FI
from siftwood.plans.printf import FormatError, compile_format
from siftwood.sources import catalog

NS = 10**9
DAY, NOW = 86400, 1_700_000_000


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "a" / "deep").mkdir(parents=True)
    (root / "empty").mkdir()
    for name, size in (("a/x.c", 0), ("a/deep/y.h", 513), ("a/.hidden", 1024), ("top.txt", 1)):
        (root / name).write_bytes(b"z" * size)
    os.link(root / "top.txt", root / "twin.txt")
    os.symlink("top.txt", root / "good")
    os.symlink("nowhere", root / "bad")
    os.symlink("loop", root / "loop")
    return catalog.crawl(spark, str(root)), str(root)


def ask(tree, *args, **context):
    rows, root = tree
    return sorted(r.path.removeprefix(root + "/") for r in FI.paths(rows, [root, *args], FI.Context(NOW * NS, **context)).collect())


@pytest.mark.parametrize(
    ("args", "expected"),
    [
        (["-name", "*.[ch]"], ["a/deep/y.h", "a/x.c"]),
        (["-type", "l"], ["bad", "good", "loop"]),
        (["-empty"], ["a/x.c", "empty"]),
        (["-type", "f", "-size", "2"], ["a/.hidden", "a/deep/y.h"]),
        (["-size", "-1", "-type", "f"], ["a/x.c"]),
        (["-maxdepth", "1", "-type", "d", "-mindepth", "1"], ["a", "empty"]),
        (["-name", "deep", "-prune", "-o", "-name", "*.?", "-print"], ["a/x.c"]),
        (["-name", "a", "-prune"], ["a"]),
        (["-depth", "-name", "a", "-prune", "-o", "-name", "*.h"], ["a", "a/deep/y.h"]),
        (["-links", "2", "-type", "f"], ["top.txt", "twin.txt"]),
        (["-lname", "no*"], ["bad"]),
        (["!", "-type", "d", "(", "-name", "t*", "-o", "-name", "b*", ")"], ["bad", "top.txt", "twin.txt"]),
        (["-regex", ".*/[xy]\\.[ch]"], ["a/deep/y.h", "a/x.c"]),
        (["-false", ",", "-name", "top*"], ["top.txt"]),
    ],
)
def test_expressions(tree, args, expected):
    assert ask(tree, *args) == expected


def test_samefile_and_newer(tree):
    rows, root = tree
    ref = rows.filter(F.col("name") == "top.txt").first().asDict()
    assert ask(tree, "-samefile", "R", references={"R": ref}) == ["top.txt", "twin.txt"]
    assert ask(tree, "-newer", "R", "-name", "top.txt", references={"R": ref}) == []
    with pytest.raises(FI.FindError):
        ask(tree, "-samefile", "missing")


def test_followed_links(tree):
    rows, root = tree
    got = {r.name: r.follow_kind for r in FI.with_followed(rows).filter("kind = 'symlink'").collect()}
    assert got == {"good": "file", "bad": None, "loop": "loop"}
    printed = FI.find(FI.with_followed(rows), [root, "-type", "l", "-printf", "%f%Y "], FI.Context(NOW * NS))
    assert sorted(r.record for r in printed.collect()) == ["badN ", "goodf ", "loopL "]


@pytest.mark.parametrize(("text", "minutes", "hits"), [("1", False, [DAY, DAY + 1, 2 * DAY - 1]), ("+1", False, [2 * DAY, 3 * DAY]), ("-1", False, [-5, 0, 59, 60, 61, DAY - 1]), ("1", True, [59, 60]), ("-1", True, [-5, 0, 59]), ("+1", True, [61, DAY - 1, DAY, DAY + 1, 2 * DAY - 1, 2 * DAY, 3 * DAY]), ("1.0", False, [DAY, DAY + 1, 2 * DAY - 1]), ("+1.0", False, [2 * DAY + 0, 3 * DAY][1:])])
def test_ages(spark, text, minutes, hits):
    ages = [-5, 0, 59, 60, 61, DAY - 1, DAY, DAY + 1, 2 * DAY - 1, 2 * DAY, 3 * DAY]
    rows = spark.createDataFrame([(a * NS,) for a in ages], "d long")
    assert sorted(r.d // NS for r in rows.filter(FI.age_test(F.col("d"), text, minutes)).collect()) == hits


@pytest.mark.parametrize(("text", "modes"), [("644", [0o644]), ("-600", [0o644, 0o4755, 0o1777]), ("/022", [0o1777]), ("/0", [0o644, 0o4755, 0o1777, 0]), ("-u+s", [0o4755])])
def test_perm(spark, text, modes):
    rows = spark.createDataFrame([(m, "file") for m in (0o644, 0o4755, 0o1777, 0)], "mode int, kind string")
    assert sorted(r.mode for r in rows.filter(FI.perm_test(F.col("mode"), F.col("kind"), text)).collect()) == sorted(modes)


def test_printf(spark):
    row = spark.createDataFrame([("/r/d/a b", "a b", "/r", 2, "file", 1536, NOW, 7, 0o4755, 5)], "path string, name string, root string, depth int, kind string, size long, mtime_s long, mtime_ns int, mode int, uid long")
    one = lambda f: row.select(compile_format(f)).first()[0]
    assert one("%p|%P|%H|%f|%h|%d|%y") == "/r/d/a b|d/a b|/r|a b|/r/d|2|f"
    assert one("%s %6s|%-6s|%06s|%k %b") == "1536   1536|1536  |001536|2 4"
    assert one("%m %#m %M") == "4755 04755 -rwsr-xr-x"
    assert one("%TY-%Tm-%Td %TH:%TM %T@ %Tj %Ta") == "2023-11-14 22:13 1700000000.0000000070 318 Tue"
    assert one("a\\tb\\n\\101\\c ignored") == "a\tb\nA"
    assert one("%%%.2f") == "%a "
    assert one("%S") == "1.33333"
    for bad in ("%", "%Z", "%q"):
        with pytest.raises(FormatError):
            compile_format(bad)


@pytest.mark.parametrize("args", [["-name"], ["-type", "q"], ["-type", "f,f"], ["("], ["(", ")"], [")"], ["-o", "-true"], ["-size", "1x"], ["-context", "x"], ["-mtime", "x"], ["-bogus"], ["-maxdepth", "-1"], ["-perm", "u+q"]])
def test_errors(spark, args):
    with pytest.raises(ValueError):
        FI.compile_expression(FI.parse(args), FI.Context(0))


def test_actions(tree):
    rows, root = tree
    found = FI.find(rows, [root, "-name", "*.txt", "-print0", "-fprint", "out", "-delete"], FI.Context(NOW * NS))
    kinds = sorted((r.action, r.target, r.record.removeprefix(root)[:9]) for r in found.collect())
    assert len(kinds) == 6 and {k[1] for k in kinds} == {None, "out"}
    with pytest.raises(FI.FindError):
        FI.find(rows, [root, "-exec", "true", ";", "-print"], FI.Context(0))
    assert FI.find(rows, [root, "-exec", "true", ";", "-print"], FI.Context(0), call=lambda a: F.col("name") == "top.txt").filter("action = 1").count() == 1
    quit_ = FI.paths(rows, [root, "-name", "to*", "-print", "-quit"], FI.Context(0)).collect()
    assert [r.path for r in quit_] == [f"{root}/top.txt"]
