"""Lookups, censuses and folds at size: what their plans do, and that results stay the same."""

import os

import pytest
from pyspark.sql import functions as F

from siftwood.functions import text as T
from siftwood.operators import index
from siftwood.plans import grep as G
from siftwood.plans import registry
from siftwood.streaming import feeds

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
BLOB = "x9Kd8QzL2mVb7RtY4wPqS1nH"
TEXTS = [
    "getHTTPRequest2xx snake_case_2 a1b2 _x_ __ 9", "ΣΑΣ_β ΑΣΒ αΣ1β ΟΔΟΣ.Α", "Kelvin İstanbul ı ſtop WITH", "with-this With_this THISwith", "", " \n\t", "x" * 70 + " é" * 3 + "é" * 40,
    f"{BLOB}== (é{BLOB}= {BLOB}é {BLOB}/with/words", f"{BLOB}", "Tion stre IoN\nshingles tioN", None, "日本語 テスト１２ ⅷ ½x",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()))


# F1


def test_a_text_is_tokenized_once(docs):
    plan = optimized(index.build(docs).postings)
    assert plan.count("regexp_extract_all(text#") == 1


def test_tokens_are_those_of_runs_and_units(docs):
    text = F.col("text")
    by_definition = F.array_distinct(F.transform(F.concat(T.runs(text), T.units(text)), F.lower))
    both = docs.select(F.sort_array(T.tokens(text)).alias("a"), F.sort_array(by_definition).alias("b")).collect()
    assert [r.a for r in both] == [r.b for r in both] and both[0].a == sorted("gethttprequest2xx get http request 2 xx snake_case_2 snake case a1b2 a 1 b _x_ x __ 9".split())


@pytest.mark.parametrize("terms", [["with"], ["kelvin", "stop"], ["i", "ı"], ["οδος"], ["a", "1"], ["x" * 64], ["nothing"], ["x++", "__"]])
def test_lookups_find_what_the_whole_index_has(docs, terms):
    built = index.build(docs)
    assert rows(built.with_terms(terms)) == rows(built.postings.filter(F.col("term").isin(*terms)))


@pytest.mark.parametrize("keys", [["ion", "tio", "kel", "elv"], ["n\ns", " st", "(é"], [".*?", "Î£Î"], [f"{c}{d}e" for c in "abcdefst" for d in "thrlo"]])
def test_key_lookups_find_what_the_whole_index_has(docs, keys):
    built = index.build(docs)
    assert rows(built.with_keys(keys)) == rows(built.grams.filter(F.col("key").isin(*keys)))


@needs_data
def test_search_indexed_doesnt_list_all_trigrams(spark):
    plan = optimized(registry.queries()["search_indexed"](spark, DATA))
    assert "(?s)(?=(...))" not in plan and "(?iu)with" in plan


def test_counts_wait_until_asked(spark, docs, monkeypatch):
    monkeypatch.setattr(index.Explanation, "_counted", property(lambda self: pytest.fail("counted")))
    truths, told = index.plan_content(index.build(docs.filter("doc_id > 1")), docs.select("doc_id"), ["text:with"], scan=True)
    assert len(truths) == 1 and (told.live, told.uncovered) == (len(TEXTS), 2)


# F2


@needs_data
def test_counting_matches_keeps_no_spans(spark):
    plan = optimized(registry.queries()["grep_empty_matches"](spark, DATA))
    assert "pythonUDF" in plan and "sum(size(" not in plan


def test_spans_in_bytes(spark):
    lines = ["aé日b", "", "bb", "éa"]
    plan = G.parse(["b*"])
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k long, line string").coalesce(1)
    got = {r.k: ([(s.start, s.end) for s in r.s], r.n) for r in df.select("k", G.line_spans(plan)(F.col("line")).alias("s"), G.span_counts(plan)(F.col("line")).alias("n")).collect()}
    want = {k: [(len(x[:a].encode()), len(x[:b].encode())) for a, b in G.spans(plan.python, x)] for k, x in enumerate(lines)}
    assert got == {k: (s, len(s)) for k, s in want.items()} and want[0] == [(0, 0), (1, 1), (3, 3), (6, 7)]


# F3


def test_merging_reads_a_document_once_and_compares_no_postings(spark, docs):
    parts = [index.build(docs.filter(f"doc_id % 4 in ({k}, 3)")) for k in range(3)]
    merged = index.merge(parts, docs.filter("doc_id % 10 <> 7"))
    assert "Aggregate [term" not in optimized(merged.postings)
    whole = index.build(docs.filter("doc_id % 10 <> 7"))
    assert rows(merged.postings) == rows(whole.postings) and rows(merged.grams) == rows(whole.grams) and rows(merged.coverage) == rows(whole.coverage)


def test_merging_counts_a_repeated_id_once(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (1, "beta gamma"), (2, "beta"), (None, "beta")], "doc_id long, text string")
    merged = index.merge([index.build(docs), index.build(docs.filter("doc_id = 2"))], docs)
    assert rows(index.terms(merged.postings)) == [("alpha", 1), ("beta", 2), ("gamma", 1)]


# lookups

LOOKUPS = {"postings_or": "(?iu)worthless", "postings_and": "(?iu)this", "postings_and_not": "(?iu)with", "postings_maybe": "(?iu)with", "trigram_screened": "(?is)"}


@needs_data
@pytest.mark.parametrize("name", LOOKUPS)
def test_lookups_skip_what_cannot_hold_the_term(spark, name):
    plan = optimized(registry.queries()[name](spark, DATA))
    assert LOOKUPS[name] in plan and "(?s)(?=(...))" not in plan


# F7


def test_bursts_are_folded_without_a_frame_for_each_session(spark):
    events = [(f"r{k % 37}", k * 7919 % 20_000, f"s{k % 5}") for k in range(12_000)]
    df = spark.createDataFrame(events, "root string, ms long, scope string")
    out = feeds.bursts(df)
    assert "FlatMapGroupsInPandas" not in optimized(out)
    want = sorted((root, a, b, s, n, over) for root in {e[0] for e in events} for a, b, s, n, over in feeds.fold_bursts(sorted(e[1:] for e in events if e[0] == root)))
    assert sorted(tuple(r)[:-1] for r in out.collect()) == want and len(want) > 500


def test_a_burst_of_too_many_scopes_holds_none(monkeypatch):
    monkeypatch.setattr(feeds, "MOST_PENDING", 3)
    assert feeds.fold_bursts([(k, f"s{k % 4}") for k in range(8)] + [(900, "a")]) == [(0, 7, [], 8, True), (900, 900, ["a"], 1, False)]


# F8


def test_only_runs_go_to_python_and_blobs_go(spark, docs):
    def blanked(value):
        for a, b in reversed(T.base64_spans(value)):
            value = value[:a] + " " + value[b:]
        return value

    out = docs.filter("text is not null").select("text", T.without_blobs(F.col("text")).alias("clean"))
    assert all(r.clean == blanked(r.text) for r in out.collect())
    assert "regexp_extract_all" in optimized(out)


# censuses

CENSUSES = {"dictionary_merge": 3, "index_follow": 2}


@needs_data
@pytest.mark.parametrize("name", CENSUSES)
def test_censuses_tokenize_each_text_once(spark, name):
    assert optimized(registry.queries()[name](spark, DATA)).count("regexp_extract_all(text#") == CENSUSES[name]
