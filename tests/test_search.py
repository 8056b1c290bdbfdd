import pytest
from pyspark.sql import functions as F

from siftwood.operators import index
from siftwood.plans import search as S

NOW = 1_000_000


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [("/r/a/main.rs", "main.rs", "file", 2000, NOW - 10, 1), ("/r/a/.rs", ".rs", "file", 5, NOW - 90_000, 2), ("/r/b", "b", "dir", 0, NOW, None), ("/r/b/İx_Kelvin.txt", "İx_Kelvin.txt", "file", 1024, NOW - 4000, 3), ("/r/b/link", "link", "symlink", 3, NOW, None), ("/r/p", "p", "fifo", 0, NOW, None), ("/r", "r", "dir", 0, NOW, None)]
    entries = spark.createDataFrame([(p, n, k, s, m, d, p.count("/") - 1) for p, n, k, s, m, d in rows], "path string, name string, kind string, size long, mtime_s long, doc_id long, depth int")
    docs = spark.createDataFrame([(1, "fn parseHttpRequest() {}\nserde request, handler"), (2, ""), (3, "Request_Handler here foo_bar")], "doc_id long, text string")
    return entries, docs


def ask(catalog, *args, **options):
    return sorted(r.path for r in S.search(*catalog, list(args), NOW, **options).collect())


@pytest.mark.parametrize(
    ("args", "expected"),
    [
        ([], ["/r/a/.rs", "/r/a/main.rs", "/r/b", "/r/b/link", "/r/b/İx_Kelvin.txt"]),
        (["MAIN"], ["/r/a/main.rs"]),
        (["case:MAIN"], []),
        (["ext:rs"], ["/r/a/main.rs"]),
        (["b/"], ["/r/b/link", "/r/b/İx_Kelvin.txt"]),
        (["type:link"], ["/r/b/link"]),
        (["size:1k"], ["/r/b/İx_Kelvin.txt"]),
        (["mtime:<1h", "type:f"], ["/r/a/main.rs"]),
        (["mtime:>1d"], ["/r/a/.rs"]),
        (["text:request handler"], ["/r/a/main.rs", "/r/b/İx_Kelvin.txt"]),
        (["text:HttpRequest"], ["/r/a/main.rs"]),
        (["text:parsehttprequest"], ["/r/a/main.rs"]),
        (["text:httprequest"], []),
        (["text:http"], ["/r/a/main.rs"]),
        (["text:foo_bar"], ["/r/b/İx_Kelvin.txt"]),
        (["case:text:request"], ["/r/a/main.rs"]),
        (["NOT", "text:serde", "type:f"], ["/r/a/.rs", "/r/b/İx_Kelvin.txt"]),
        (["name-term:kelvin"], ["/r/b/İx_Kelvin.txt"]),
        (["re:KELVIN"], ["/r/b/İx_Kelvin.txt"]),
        (["grep:^serde"], ["/r/a/main.rs"]),
        (["main", "or", "(", "type:d", "and", "not", "x", ")"], ["/r/a/main.rs", "/r/b"]),
    ],
)
def test_atoms(catalog, args, expected):
    assert ask(catalog, *args) == expected


def test_scope_and_offset(catalog):
    assert ask(catalog, scope="/r/a") == ["/r/a/.rs", "/r/a/main.rs"]
    row = S.search(*catalog, ["grep:serde"], NOW).first()
    assert row.offset == 25


@pytest.mark.parametrize(("args", "kind"), [(["("], "missing-operand"), (["(", "a"], "unclosed-group"), (["a", ")"], "unopened-group"), (["NOT"], "missing-operand"), (["a", "AND"], "missing-operand"), (["size:x"], "bad-size"), (["size:99999999999t"], "size-overflow"), (["mtime:3d"], "bad-age"), (["type:q"], "bad-type"), (["re:("], "bad-regex"), (["ext:"], "empty-value"), (["case:"], "empty-case"), (["a OR b"], "embedded-operator"), (["name-term:a b"], "bad-token"), (["text:--"], "no-token"), (["NOT"] * 40 + ["a"], "too-deep")])
def test_errors(args, kind):
    with pytest.raises(S.SearchError) as e:
        S.parse(args)
    assert e.value.kind == kind


def test_index_answers_alike(catalog):
    entries, docs = catalog
    live = docs.select("doc_id")
    part = index.build(docs.filter("doc_id <> 3"))
    for args in (["text:request handler"], ["text:serde"], ["NOT", "text:serde"], ["grep:Handler", "OR", "text:http"]):
        truths, told = index.plan_content(part, live, args, scan=True)
        assert told.uncovered == 1
        assert sorted(r.path for r in S.search(entries, docs, args, NOW, truths=truths).collect()) == ask(catalog, *args)
    whole = index.follow(part, docs)
    assert whole.coverage.count() == 3
    with pytest.raises(index.Refused):
        index.plan_content(part, live, ["grep:e"])


def test_kleene_sets(spark):
    t = spark.createDataFrame([(1, True), (2, None), (3, True)], "doc_id long, truth boolean")
    u = spark.createDataFrame([(1, None), (2, True), (4, True)], "doc_id long, truth boolean")
    as_dict = lambda df: {r.doc_id: r.truth for r in df.collect()}
    assert as_dict(index.both(t, u)) == {1: None, 2: None}
    assert as_dict(index.either(t, u)) == {1: True, 2: True, 3: True, 4: True}
    assert as_dict(index.but_not(t, u)) == {1: None, 3: True}
    assert as_dict(index.complement(spark.range(1, 6).toDF("doc_id"), u)) == {1: None, 3: True, 5: True}


def test_segments():
    assert index.merge_segments([(f"s{i}", 1 << 20, 0) for i in range(10)]) == [[f"s{i}" for i in range(10)]]
    assert index.merge_segments([("a", 100, 50)]) == [["a"]]


def test_json(catalog):
    rows = [r.value for r in S.search_json(S.search(*catalog, ["main"], NOW)).collect()]
    assert rows == ['{"path":"/r/a/main.rs","type":"file","size":2000,"mtime":999990,"doc":1}']


def test_wide_case(spark):
    # ASCII folding leaves the Kelvin sign alone, Unicode folding doesn't
    row = spark.range(1).select(F.lit("K").alias("name"))
    assert not row.filter(S.parse_atom("k").test(F.col, 0)).count()
    assert row.filter(S.parse_atom("re:k").test(F.col, 0)).count()
