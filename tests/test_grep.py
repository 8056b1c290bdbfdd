import json

import pytest
from pyspark.sql import functions as F

from siftwood.plans import grep as G

TEXT = {1: "alpha beta\nBeta gamma\n\nshort\nalpha-alpha end", 2: "", 3: "no newline", 4: "tail\n", 5: "﻿bom line\nİstanbul K é\n", 6: "a\x00b alpha\nalpha"}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sorted(TEXT.items()), "id long, text string")


def lines(docs, run, *args, read_file=None):
    return sorted(tuple(r) for r in run(docs, G.parse(list(args), read_file), ["id"]).collect())


def test_lines(docs):
    rows = sorted(tuple(r) for r in G.lines_of(docs, ["id"]).collect())
    assert [r for r in rows if r[0] == 1] == [(1, 1, "alpha beta"), (1, 2, "Beta gamma"), (1, 3, ""), (1, 4, "short"), (1, 5, "alpha-alpha end")]
    assert [r for r in rows if r[0] in (2, 4)] == [(4, 1, "tail")]
    assert (5, 1, "bom line") in rows


@pytest.mark.parametrize(
    ("args", "expected"),
    [
        (["alpha"], [(1, 1), (1, 5)]),
        (["-a", "alpha"], [(1, 1), (1, 5), (6, 1), (6, 2)]),
        (["-i", "BETA"], [(1, 1), (1, 2)]),
        (["-S", "beta"], [(1, 1), (1, 2)]),
        (["-S", "Beta"], [(1, 2)]),
        (["-v", "a"], [(1, 3), (1, 4), (3, 1), (5, 1)]),
        (["-w", "alph"], []),
        (["-w", "alpha"], [(1, 1), (1, 5)]),
        (["-x", "short|tail"], [(1, 4), (4, 1)]),
        (["-F", "a-a"], [(1, 5)]),
        (["-m", "1", "a"], [(1, 1), (4, 1), (5, 2)]),
        (["-m0", "a"], []),
        (["^$"], [(1, 3)]),
        (["-e", "short", "-e", "tail"], [(1, 4), (4, 1)]),
        (["-i", "k"], [(5, 2)]),
    ],
)
def test_selection(docs, args, expected):
    assert [r[:2] for r in lines(docs, G.grep, *args)] == expected


def test_replace_and_only_matching(docs):
    assert lines(docs, G.grep, "-r", "<$1>$$ $1X ${1}x", "(alp)ha")[0] == (1, 1, "<alp>$  alpx beta")
    assert lines(docs, G.grep, "-r", "[${w}]", "(?P<w>short)") == [(1, 4, "[short]")]
    assert [r[3] for r in lines(docs, G.only_matching, "-o", "alp[a-z]+")] == ["alpha"] * 3
    assert [r[3] for r in lines(docs, G.only_matching, "-o", "-r", "<$0>", "alpha")] == ["<alpha>"] * 3
    assert lines(docs, G.grep, "-M", "8", "alpha")[0][2] == "[Omitted long matching line]"


def test_counts(docs):
    assert lines(docs, G.count_lines, "-c", "alpha") == [(1, 2)]
    assert lines(docs, G.count_lines, "-c", "--include-zero", "alpha") == [(1, 2), (2, 0), (3, 0), (4, 0), (5, 0), (6, 0)]
    assert lines(docs, G.count_matches, "--count-matches", "alpha") == [(1, 3)]
    assert lines(docs, G.files_with, "-l", "alpha") == [(1,)]
    assert lines(docs, G.files_without, "--files-without-match", "alpha") == [(2,), (3,), (4,), (5,), (6,)]
    assert G.exists(docs, G.parse(["-q", "short"]), ["id"]) and not G.exists(docs, G.parse(["-q", "zzz"]), ["id"])
    assert tuple(G.summary(docs, G.parse(["alpha"]), ["id"]).first())[:4] == (6, 1, 2, 3)


def test_empty_matches_follow_the_language(spark):
    one = spark.createDataFrame([(1, "abc")], "id long, text string")
    assert lines(one, G.count_matches, "--count-matches", "a*") == [(1, 3)]
    assert list(G.spans(G.parse(["a*"]).python, "abc")) == [(0, 1), (2, 2), (3, 3)]
    assert lines(one, G.count_matches, "--count-matches", "") == [(1, 4)]


def test_context(docs):
    rows = lines(docs, G.with_context, "-A1", "-B1", "short")
    assert [(r[1], r[3]) for r in rows] == [(3, False), (4, True), (5, False)]
    rows = lines(docs, G.with_context, "-C1", "-m1", "alpha")
    assert [(r[1], r[3], r[4]) for r in rows] == [(1, True, 1), (2, False, 1)]
    assert {r[4] for r in lines(docs, G.with_context, "-C0", "alpha")} == {1, 2}


def test_multiline(docs):
    run = lambda *a: sorted(tuple(r) for r in G.multiline(docs, G.parse(["-U", *a]), "id").collect())
    assert run("beta\\nBeta") == [(1, 1, 2, 6, 15, 1)]
    assert run("--multiline-dotall", "alpha.*gamma") == [(1, 1, 2, 0, 21, 1)]
    assert run("gamma.short") == []
    assert len(run("-m", "1", "alpha")) == 1


def test_json_events(docs):
    rows = docs.select(F.col("id").cast("string").alias("path"), "text")
    got = [json.loads(r.value) for r in G.json_events(rows, G.parse(["--json", "Istan|stan|é"])).orderBy("path", "seq").collect()]
    assert [g["type"] for g in got] == ["begin", "match", "end"]
    data = got[1]["data"]
    assert (data["line_number"], data["absolute_offset"]) == (2, 9)
    assert [(s["match"]["text"], s["start"], s["end"]) for s in data["submatches"]] == [("stan", 2, 6), ("é", 15 - 1, 17 - 1)] or data["submatches"][0]["start"] == 2


def test_binary(docs):
    rows = G.binary_documents(docs, G.parse(["a"]), ["id"]).collect()
    assert [r.id for r in rows] == [6] and "offset 1" in rows[0].message


def test_file_selection(spark):
    names = ["/r/a.py", "/r/.hid/b.py", "/r/c/Makefile", "/r/c/d.rs", "/r/c/e.txt"]
    rows = spark.createDataFrame([(n, n.rsplit("/", 1)[1], "/r", "file", n.count("/") - 1, k if k != 2 else None, 0) for k, n in enumerate(names)], "path string, name string, root string, kind string, depth int, mtime_s long, mtime_ns int")
    pick = lambda *a: [r.path for r in G.names(rows, G.parse(["--files", *a])).collect()]
    assert sorted(pick()) == ["/r/a.py", "/r/c/Makefile", "/r/c/d.rs", "/r/c/e.txt"]
    assert sorted(pick("--hidden", "-t", "py")) == ["/r/.hid/b.py", "/r/a.py"]
    assert pick("-t", "make") == ["/r/c/Makefile"]
    assert sorted(pick("-T", "rust", "-T", "txt")) == ["/r/a.py", "/r/c/Makefile"]
    assert sorted(pick("-g", "*.{py,rs}")) == ["/r/a.py", "/r/c/d.rs"]
    assert sorted(pick("-g", "!c/**")) == ["/r/a.py"]
    assert pick("-g", "*", "-g", "!*.py", "-g", "a*") and "/r/a.py" in pick("-g", "*", "-g", "!*.py", "-g", "a*")
    assert pick("--sort", "modified")[-1] == "/r/c/Makefile" and pick("--sortr", "modified")[0] == "/r/c/Makefile"
    assert sorted(pick("--max-depth", "1")) == ["/r/a.py"]


def test_arguments():
    p = G.parse(["-inC", "2", "-r", "x", "-g", "*.c", "pat", "dir"])
    assert (p.case, p.context, p.values["replace"], p.globs, p.paths) == ("i", (2, 2), "x", ["*.c"], ["dir"])
    assert G.parse(["-A3", "-C1", "x"]).context == (1, 3)
    assert G.parse(["-f", "p"], read_file=lambda n: ["a\r", "b"]).patterns == ["a", "b"]
    for bad in (["--pcre2", "x"], ["-m", "x", "y"], [], ["--nope", "x"], ["("], ["--sort", "path", "x"]):
        with pytest.raises(G.GrepError):
            G.parse(bad)
