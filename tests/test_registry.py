"""Every registered query of the engine against its SQL in DuckDB."""

import os

import pytest

from siftwood.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr([plain(x) for x in r]) for r in df.select(*columns).collect())
    sql = registry.oracle_sql()[name]
    want = duck.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({sql})").fetchall()
    assert got == sorted(repr([plain(x) for x in r]) for r in want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0


def test_bursts_match_the_fold_over_all_events(spark, duck):
    from siftwood.streaming import feeds

    got = sorted((r.root, r.first_ms, r.last_ms, tuple(r.scopes), r.n) for r in registry.queries()["stream_bursts"](spark, DATA).collect())
    by: dict[str, list] = {}
    for user, ms, kind in duck.execute("SELECT user_id, epoch_us(ts) // 1000 % 5000, event_type FROM events").fetchall():
        by.setdefault(str(user), []).append((ms, kind))
    want = sorted((root, a, b, tuple(s), n) for root, events in by.items() for a, b, s, n, _ in feeds.fold_bursts(sorted(events)))
    assert got == want


def test_json_events_name_each_match(spark, duck):
    import json
    import re

    events = [json.loads(r.value) for r in registry.queries()["grep_json_events"](spark, DATA).collect()]
    got = sorted((e["data"]["path"]["text"], e["data"]["line_number"], [(s["start"], s["end"]) for s in e["data"]["submatches"]]) for e in events if e["type"] == "match")
    want = []
    for path, text in duck.execute(f"WITH {registry.FILES} SELECT path, text FROM files").fetchall():
        for number, line in enumerate(text.split("\n"), 1):
            found = [(len(line[: m.start()].encode()), len(line[: m.end()].encode())) for m in re.finditer("tionst", line)]
            if found:
                want.append((path, number, found))
    assert got == sorted(want) and {e["type"] for e in events} == {"begin", "match", "context", "end"}


def test_multiline_groups_by_brute_force(spark, duck):
    import re

    got = {(r.doc_id, r.start, r.end, r.n_matches) for r in registry.queries()["grep_multiline"](spark, DATA).collect() if r.n_matches == 1}
    every = sum(r.n_matches for r in registry.queries()["grep_multiline"](spark, DATA).collect())
    spans = {(i, len(t[: m.start()].encode()), len(t[: m.end()].encode()), 1) for i, t in duck.execute("SELECT doc_id, text FROM documents").fetchall() for m in re.finditer("\\.\nThe", t)}
    assert got <= spans and every == len(spans)


def test_pushdown_reaches_the_scan(spark):
    plan = registry.queries()["size_cmp"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
    grams = spark.read.parquet(f"{DATA}/part.parquet").filter("p_name = 'x'").select("p_partkey")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(p_name,x)" in grams
