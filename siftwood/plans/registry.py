"""The engine's own queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.functions import text as T
from siftwood.operators import ignore, index, reconcile, stats
from siftwood.plans import find as find_plan
from siftwood.plans import grep as grep_plan
from siftwood.plans import search as search_plan
from siftwood.plans import trigram
from siftwood.plans.printf import compile_format
from siftwood.sources import catalog
from siftwood.streaming import feeds

#: A fixed now, so that ages are the same wherever a query runs.
NOW = 1_706_745_600
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

FILES = """files AS (
  SELECT d.doc_id, '/corpus/' || source || '/' || lang || '/doc_' || d.doc_id || CASE WHEN d.doc_id % 5 = 0 THEN '.rs' ELSE '.txt' END AS path, 'doc_' || d.doc_id || CASE WHEN d.doc_id % 5 = 0 THEN '.rs' ELSE '.txt' END AS name, '/corpus/' || source || '/' || lang AS parent,
         octet_length(encode(text))::BIGINT AS size, epoch_us(ts) // 1000000 + d.doc_id * 7 % 25 * 86400 AS mtime_s, ((epoch_us(ts) % 1000000) * 1000)::INT AS mtime_ns, user_id AS uid, user_id % 7 AS gid,
         (d.doc_id * 73) % 4096 AS mode, d.doc_id + 1000 AS ino, text, 3 AS depth, 'file' AS kind
  FROM documents d JOIN events e ON e.event_id = d.doc_id)"""
TREE = FILES + """, entries AS (
  SELECT path, name, depth, kind, size, NULL::BIGINT AS entries, mode, 1 AS dev, ino, 1 AS nlink, uid, NULL AS target, 'Hashed' AS state FROM files
  UNION ALL SELECT '/corpus', 'corpus', 0, 'dir', 4096, count(DISTINCT source) + 1, 493, 1, -1, 2, 0, NULL, NULL FROM documents
  UNION ALL SELECT '/corpus/' || source, source, 1, 'dir', 4096, count(DISTINCT lang), 493, 1, -1, 2, 0, NULL, NULL FROM documents GROUP BY source
  UNION ALL SELECT '/corpus/' || source || '/' || lang, lang, 2, 'dir', 4096, count(*), 493, 1, -1, 2, 0, NULL, NULL FROM documents GROUP BY source, lang
  UNION ALL SELECT '/corpus/extra', 'extra', 1, 'dir', 4096, count(*) - 2, 493, 1, 499, 2, 0, NULL, NULL FROM nation
  UNION ALL SELECT '/corpus/extra/' || CASE WHEN n IN (21, 23) THEN 'x22/' ELSE '' END || 'x' || n, 'x' || n, CASE WHEN n IN (21, 23) THEN 3 ELSE 2 END, CASE n % 5 WHEN 0 THEN 'symlink' WHEN 2 THEN 'dir' WHEN 4 THEN CASE WHEN n < 10 THEN 'fifo' WHEN n < 15 THEN 'socket' WHEN n < 20 THEN 'block' ELSE 'character' END ELSE 'file' END,
         CASE n % 5 WHEN 3 THEN 700 WHEN 2 THEN 4096 WHEN 0 THEN length(t) ELSE 0 END, CASE WHEN n = 22 THEN 2 WHEN n % 5 = 2 THEN 0 END, n * 73 % 4096, CASE WHEN n >= 20 THEN 2 ELSE 1 END, CASE n % 5 WHEN 3 THEN 900 + n // 20 ELSE 500 + n END, CASE WHEN n % 5 = 3 AND n < 20 THEN 4 ELSE 1 END, n + 1000000, t, 'Unindexed'
  FROM (SELECT n_nationkey AS n, CASE n_nationkey WHEN 0 THEN '/corpus/src1' WHEN 5 THEN '/corpus/missing' WHEN 10 THEN '/corpus/src3/en' WHEN 15 THEN 'x15' WHEN 20 THEN 'x0' END AS t FROM nation))"""
LINES = """lines AS (
  SELECT doc_id, unnest(generate_series(1, len(l)))::BIGINT AS line_no, unnest(l) AS line
  FROM (SELECT doc_id, CASE WHEN text = '' THEN [] WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[1:-2] ELSE string_split(text, chr(10)) END AS l FROM documents))"""
HIT = "SELECT path, kind AS type, size, mtime_s AS mtime, doc_id AS doc, NULL::BIGINT AS \"offset\" FROM files"
UNITS = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(\p{{N}})([^\p{{N}}_])', '\1 \2', 'g'), '([^\p{{N}}_])(\p{{N}})', '\1 \2', 'g'), '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g')"
LINE_TEXT = "(' ' || lower(regexp_replace(" + UNITS.format("text") + r", '[^\p{L}\p{N}]+', ' ', 'g')) || ' ')"

RUN_TEXT = r"(' ' || regexp_replace(text, '[^\p{L}\p{N}_]+', ' ', 'g') || ' ')"


def _term(word: str) -> str:
    return f"(contains({LINE_TEXT}, ' {word} ') OR contains(lower({RUN_TEXT}), ' {word} '))"


def query(name: str, sql: str | None = None):
    def keep(run: Query) -> Query:
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return run

    return keep


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.corpus_documents(spark, sf_dir)


def _search(name: str, args: list[str], where: str, **options) -> None:
    @query(name, f"WITH {FILES} {HIT} WHERE {where}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search_plan.search(catalog.corpus_files(spark, sf_dir), _docs(spark, sf_dir), args, NOW, **options)


_search("name_substr", ["doc_12"], "contains(lower(name), 'doc_12')")
_search("path_substr", ["src1/EN"], "contains(lower(path), 'src1/en')")
_search("path_case", ["case:path:src1/en"], "contains(path, 'src1/en')")
_search("name_glob", ["doc_?[0-4]*.TXT"], r"regexp_matches(name, '^(?i:doc_[^/][0-4][^/]*\.txt)$')")
_search("path_glob", ["src*/en/doc_*7.txt"], r"regexp_matches(path, '^(.*/)?src[^/]*/en/doc_[^/]*7\.txt$')")
_search("path_glob_deep", ["/corpus/**/doc_1*"], r"regexp_matches(path, '^/corpus/([^/]+/)*doc_1[^/]*$')")
_search("name_regex", ["re:^doc_\\d{2}\\."], r"regexp_matches(name, '^doc_[0-9]{2}\.')")
_search("ext", ["ext:txt", "NOT", "ext:rs"], "ends_with(lower(name), '.txt') AND NOT ends_with(lower(name), '.rs')")
_search("name_term", ["name-term:doc_42"], "name = 'doc_42.txt'")
_search("size_cmp", ["size:>2k", "size:<1m"], "size > 2048 AND size < 1048576")
_search("mtime_age", ["mtime:<3w", "mtime:>5d"], f"({NOW} - mtime_s) < 1814400 AND ({NOW} - mtime_s) > 432000")
_search("bool_kleene", ["(", "doc_1", "OR", "size:>5k", ")", "NOT", "path:/fr/", "text:the"], f"(contains(name, 'doc_1') OR size > 5120) AND NOT contains(path, '/fr/') AND {_term('the')}")
_search("text_term", ["text:with"], f"{_term('with')}")
_search("text_phrase", ["text:of the"], f"contains({LINE_TEXT}, ' of the ')")
_search("text_not", ["NOT", "content:the"], f"NOT {_term('the')}")
_search("text_case", ["case:text:The"], "(contains((' ' || regexp_replace(" + UNITS.format("text") + r", '[^\p{L}\p{N}]+', ' ', 'g') || ' '), ' The ') OR contains(" + RUN_TEXT + ", ' The '))")
_search("scope_filter", ["size:>1k"], "size > 1024 AND starts_with(path, '/corpus/src1/')", scope="/corpus/src1")


@query("type_eq", f"WITH {TREE} SELECT path, kind AS type, size FROM entries WHERE kind = 'dir' AND depth > 0")
def _type_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_plan.search(catalog.corpus_entries(spark, sf_dir), None, ["type:d"], NOW).select("path", "type", "size")


@query("grep_doc_offset", f"WITH {FILES} SELECT path, kind AS type, size, mtime_s AS mtime, doc_id AS doc, octet_length(encode(substr(text, 1, strpos(text, regexp_extract(text, '(?m)tion[a-z]+ing')) - 1)))::BIGINT AS \"offset\" FROM files WHERE regexp_matches(text, 'tion[a-z]+ing')")
def _grep_doc_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_plan.search(catalog.corpus_files(spark, sf_dir), _docs(spark, sf_dir), ["grep:tion[a-z]+ing"], NOW)


@query("search_json", f"WITH {FILES} SELECT '{{\"path\":\"' || path || '\",\"type\":\"file\",\"size\":' || size || ',\"mtime\":' || mtime_s || ',\"doc\":' || doc_id || '}}' AS value FROM files WHERE contains(name, 'doc_11')")
def _search_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_plan.search_json(search_plan.search(catalog.corpus_files(spark, sf_dir), None, ["doc_11"], NOW))


def _indexed(spark: SparkSession, sf_dir: str, args: list[str]) -> DataFrame:
    docs = _docs(spark, sf_dir)
    built = index.build(docs)
    truths, _ = index.plan_content(built, docs.select("doc_id"), args, scan=True)
    return search_plan.search(catalog.corpus_files(spark, sf_dir), docs, args, NOW, truths=truths)


@query("search_indexed", f"WITH {FILES} {HIT} WHERE {_term('with')} AND NOT regexp_matches(text, 'shing[a-z]*tion')")
def _search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir, ["text:with", "NOT", "grep:shing[a-z]*tion"]).withColumn("offset", F.lit(None).cast("long"))


# ── find ──


def _context(**more) -> find_plan.Context:
    return find_plan.Context(NOW * 10**9, **more)


def _find(name: str, args: list[str], where: str, tree: bool = False, **context) -> None:
    @query(name, f"WITH {TREE if tree else FILES} SELECT path FROM {'entries' if tree else 'files'} WHERE {where}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = catalog.corpus_entries(spark, sf_dir) if tree else catalog.corpus_files(spark, sf_dir)
        return find_plan.paths(rows, args, _context(**context))


AGE = f"({NOW}::BIGINT * 1000000000 - (mtime_s * 1000000000 + mtime_ns))"
DAY, MINUTE = 86400 * 10**9, 60 * 10**9
_find("find_name", ["-name", "doc_*7*"], "regexp_matches(name, '^doc_.*7')")
_find("find_iname", ["-iname", "DOC_1?.TXT"], r"regexp_matches(name, '^doc_1.\.txt$')")
_find("find_path", ["-path", "/corpus/src1*/en/*"], "regexp_matches(path, '^/corpus/src1.*/en/')")
_find("find_regex", ["-regextype", "posix-extended", "-regex", ".*/(en|fr)/doc_[0-9]{2}\\.txt"], r"regexp_matches(path, '^.*/(en|fr)/doc_[0-9]{2}\.txt$')")
_find("find_regex_emacs", ["-regex", ".*/doc_\\(1\\|2\\)[0-9]+.txt"], "regexp_matches(path, '^.*/doc_(1|2)[0-9]+.txt$')")
_find("find_perm", ["-perm", "-222", "!", "-perm", "/111"], "(mode & 146) = 146 AND (mode & 73) = 0")
_find("find_perm_symbolic", ["-perm", "-u+w,g+r"], "(mode & 160) = 160")
_find("find_size_ceil", ["-size", "+3k", "-size", "-12"], "(size + 1023) // 1024 > 3 AND (size + 511) // 512 < 12")
_find("find_size_bytes", ["-size", "-1000c"], "size < 1000")
_find("find_mtime_floor", ["-mtime", "+20"], f"{AGE} // {DAY} > 20")
_find("find_mtime_fraction", ["-mtime", "-10.5"], f"{AGE}::DOUBLE / {DAY} < 10.5")
_find("find_mmin_ceil", ["-mmin", "+20000"], f"({AGE} + {MINUTE} - 1) // {MINUTE} > 20000")
_find("find_mmin_less", ["-mmin", "-20000"], f"{AGE} < 20000 * {MINUTE}")
_find("find_daystart", ["-daystart", "-mtime", "-20"], f"({NOW // 86400 * 86400 + 86400}::BIGINT * 1000000000 - (mtime_s * 1000000000 + mtime_ns)) // {DAY} < 20")
_find("find_newer_date", ["-newermt", "2024-01-20 12:00"], "mtime_s * 1000000000 + mtime_ns > 1705752000000000000")
_find("find_newer_relative", ["-newermt", "10 days ago"], f"mtime_s * 1000000000 + mtime_ns > ({NOW} - 864000)::BIGINT * 1000000000")
_find("find_uid", ["-uid", "-50", "-o", "-gid", "3"], "uid < 50 OR gid = 3")
_find("find_user", ["-user", "alice", "-o", "-group", "5"], "uid = 7 OR gid = 5", users={"alice": 7})
_find("find_used", ["-used", "-1"], "(1 + doc_id % 60) * 3600 < 86400")
_find("find_links_inum", ["-links", "1", "-inum", "-1100"], "ino < 1100")
_find("find_access", ["-readable", "!", "-executable"], "(mode & 292) <> 0 AND (mode & 73) = 0")
_find("find_comma_not", ["(", "-false", ",", "-name", "doc_3*", ")", "-a", "!", "-size", "+4"], "regexp_matches(name, '^doc_3') AND (size + 511) // 512 <= 4")
_find("find_type", ["-type", "d,l"], "kind IN ('dir', 'symlink')", tree=True)
_find("find_depth", ["-mindepth", "1", "-maxdepth", "2"], "depth BETWEEN 1 AND 2", tree=True)
_find("find_prune", ["-path", "/corpus/src1", "-prune", "-o", "-type", "f", "-print"], "kind = 'file' AND NOT starts_with(path, '/corpus/src1/')", tree=True)
_find("find_prune_name", ["(", "-name", "fr", "-o", "-name", "de", ")", "-prune", "-o", "-print"], "NOT regexp_matches(path, '/(fr|de)(/|$)')", tree=True)
_find("find_empty", ["-empty"], "(kind = 'file' AND size = 0) OR (kind = 'dir' AND entries = 0)", tree=True)
_find("find_start", ["/corpus/src2", "/corpus/src3/en", "-type", "f"], "kind = 'file' AND (starts_with(path, '/corpus/src2/') OR starts_with(path, '/corpus/src3/en/'))", tree=True)
_find("find_xdev", ["/corpus", "-xdev", "-type", "f"], "kind = 'file' AND NOT starts_with(path, '/corpus/extra/x22/')", tree=True)


@query("find_newer_ref", f"WITH {FILES} SELECT path FROM files WHERE mtime_s * 1000000000 + mtime_ns > (SELECT mtime_s * 1000000000 + mtime_ns FROM files WHERE doc_id = 5)")
def _find_newer_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = catalog.corpus_files(spark, sf_dir)
    # one row, the reference that the expression names
    ref = files.filter("doc_id = 5").first()
    return find_plan.paths(files, ["-newer", ref.path], _context(references={ref.path: ref.asDict()}))


@query("find_samefile", f"WITH {FILES} SELECT path FROM files WHERE ino = 1005")
def _find_samefile(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = catalog.corpus_files(spark, sf_dir)
    ref = files.filter("doc_id = 5").first()
    return find_plan.paths(files, ["-samefile", ref.path], _context(references={ref.path: ref.asDict()}))


@query("find_samefile_links", f"WITH {TREE} SELECT path FROM entries WHERE dev = 1 AND ino = 900")
def _find_samefile_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = catalog.corpus_entries(spark, sf_dir)
    ref = entries.filter("name = 'x3'").first()
    return find_plan.paths(entries, ["-samefile", ref.path], _context(references={ref.path: ref.asDict()}))


@query("find_nouser", f"WITH {FILES} SELECT path FROM files WHERE uid NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0)")
def _find_nouser(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey % 3 > 0").select("c_custkey", "c_name")
    return find_plan.paths(find_plan.with_names(catalog.corpus_files(spark, sf_dir), users), ["-nouser"], _context())


@query("find_quit", f"WITH {FILES} SELECT path FROM files WHERE contains(name, '9') ORDER BY path LIMIT 1")
def _find_quit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_plan.paths(catalog.corpus_files(spark, sf_dir), ["-name", "*9*", "-print", "-quit"], _context())


@query("find_printf", f"WITH {FILES} SELECT printf('%s|%s|%8d|%o|%-6d|', path, name, size, mode, uid) || strftime(make_timestamp(mtime_s * 1000000), '%Y-%m-%d %H:%M') || '|' || mtime_s || '.' || lpad(mtime_ns::VARCHAR, 9, '0') || '0' || chr(10) AS record FROM files")
def _find_printf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_plan.find(catalog.corpus_files(spark, sf_dir), ["-printf", "%p|%f|%8s|%m|%-6U|%TY-%Tm-%Td %TH:%TM|%T@\\n"], _context()).select("record")


@query("find_printf_path", f"WITH {TREE} SELECT substr(path, 9) || ' ' || parse_path(path)[-1] || ' ' || depth || ' ' || CASE kind WHEN 'symlink' THEN 'l' WHEN 'fifo' THEN 'p' ELSE left(kind, 1) END || ' /corpus' AS record FROM entries WHERE depth > 0")
def _find_printf_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_plan.find(catalog.corpus_entries(spark, sf_dir), ["/corpus", "-mindepth", "1", "-printf", "%P %f %d %y %H"], _context()).select("record")


@query("find_ls_mode", f"WITH {FILES} SELECT path, concat_ws('', '-', CASE WHEN mode & 256 > 0 THEN 'r' ELSE '-' END, CASE WHEN mode & 128 > 0 THEN 'w' ELSE '-' END, CASE WHEN mode & 2048 > 0 THEN (CASE WHEN mode & 64 > 0 THEN 's' ELSE 'S' END) WHEN mode & 64 > 0 THEN 'x' ELSE '-' END, CASE WHEN mode & 32 > 0 THEN 'r' ELSE '-' END, CASE WHEN mode & 16 > 0 THEN 'w' ELSE '-' END, CASE WHEN mode & 1024 > 0 THEN (CASE WHEN mode & 8 > 0 THEN 's' ELSE 'S' END) WHEN mode & 8 > 0 THEN 'x' ELSE '-' END, CASE WHEN mode & 4 > 0 THEN 'r' ELSE '-' END, CASE WHEN mode & 2 > 0 THEN 'w' ELSE '-' END, CASE WHEN mode & 512 > 0 THEN (CASE WHEN mode & 1 > 0 THEN 't' ELSE 'T' END) WHEN mode & 1 > 0 THEN 'x' ELSE '-' END) AS record FROM files")
def _find_ls_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_plan.find(catalog.corpus_files(spark, sf_dir), ["-printf", "%M"], _context()).select("path", "record")


@query("find_ls", f"WITH {FILES} SELECT concat_ws(' ', lpad(ino::VARCHAR, 9, ' '), lpad(((size + 1023) // 1024)::VARCHAR, 6, ' '), '-' || " + " || ".join(f"CASE WHEN mode & {r} > 0 THEN 'r' ELSE '-' END || CASE WHEN mode & {w} > 0 THEN 'w' ELSE '-' END || CASE WHEN mode & {s} > 0 AND mode & {x} > 0 THEN '{low}' WHEN mode & {s} > 0 THEN '{low.upper()}' WHEN mode & {x} > 0 THEN 'x' ELSE '-' END" for r, w, x, s, low in ((256, 128, 64, 2048, "s"), (32, 16, 8, 1024, "s"), (4, 2, 1, 512, "t"))) + ", '  1', rpad(uid::VARCHAR, 8, ' '), rpad(gid::VARCHAR, 8, ' '), lpad(size::VARCHAR, greatest(8, length(size::VARCHAR))::INT, ' '), strftime(make_timestamp(mtime_s * 1000000), '%b ') || lpad(day(make_timestamp(mtime_s * 1000000))::VARCHAR, 2, ' ') || strftime(make_timestamp(mtime_s * 1000000), ' %H:%M'), path) || chr(10) AS record FROM files WHERE (size + 511) // 512 > 8")
def _find_ls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_plan.find(catalog.corpus_files(spark, sf_dir), ["-size", "+8", "-ls"], _context()).select("record")


@query("find_delete_plan", f"WITH {TREE} SELECT 'NameDelete' AS kind, path, len(string_split(path, '/'))::INT AS level FROM entries WHERE starts_with(path, '/corpus/src4')")
def _find_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_plan.delete_plan(find_plan.find(catalog.corpus_entries(spark, sf_dir), ["-path", "/corpus/src4*", "-delete"], _context()))


@query("find_exec_batches", f"WITH {FILES}, f AS (SELECT *, sum(octet_length(encode(path)) + 9) OVER (PARTITION BY parent ORDER BY path) - (octet_length(encode(path)) + 9) AS upto FROM files) SELECT parent, (upto // (2000 - 12))::BIGINT AS batch, count(*) AS n FROM f GROUP BY ALL")
def _find_exec(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_plan.find(catalog.corpus_files(spark, sf_dir), ["-exec", "cat", "{}", "+"], _context())
    return find_plan.exec_batches(found, ["cat", "{}"], 2000).select("parent", "batch", F.size("arguments").cast("long").alias("n"))


# ── line search ──


def _grep(name: str, args: list[str], sql: str, run: Callable, *columns: str) -> None:
    @query(name, f"WITH {LINES} {sql}")
    def go(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = run(_docs(spark, sf_dir), grep_plan.parse(args), ["doc_id"])
        return out.select(*columns) if columns else out


W_LINES = ("doc_id", "line_no", "line")
PICK = "SELECT doc_id, line_no, line FROM lines WHERE"
_grep("grep_lines", ["tion[a-z]+ing"], f"{PICK} regexp_matches(line, 'tion[a-z]+ing')", grep_plan.grep, *W_LINES)
_grep("grep_invert", ["-v", "e"], f"{PICK} NOT contains(line, 'e')", grep_plan.grep, *W_LINES)
_grep("grep_fixed", ["-F", "re."], f"{PICK} contains(line, 're.')", grep_plan.grep, *W_LINES)
_grep("grep_word", ["-w", "sh"], rf"{PICK} regexp_matches(line, '(^|[^\p{{L}}\p{{N}}_])sh($|[^\p{{L}}\p{{N}}_])')", grep_plan.grep, *W_LINES)
_grep("grep_line", ["-x", "The.*"], f"{PICK} regexp_matches(line, '^The.*$')", grep_plan.grep, *W_LINES)
_grep("grep_ignore_case", ["-i", "THE AND"], f"{PICK} contains(lower(line), 'the and')", grep_plan.grep, *W_LINES)
_grep("grep_smart_case", ["-S", "the and"], f"{PICK} contains(lower(line), 'the and')", grep_plan.grep, *W_LINES)
_grep("grep_patterns", ["-e", "tionst", "-e", "^Er"], f"{PICK} regexp_matches(line, 'tionst|^Er')", grep_plan.grep, *W_LINES)
_grep("grep_replace", ["-r", "<$1>$$", "(tion)st"], f"SELECT doc_id, line_no, regexp_replace(line, '(tion)st', '<\\1>$', 'g') AS line FROM lines WHERE contains(line, 'tionst')", grep_plan.grep, *W_LINES)
_grep("grep_max_columns", ["-M", "300", "tionst"], "SELECT doc_id, line_no, CASE WHEN octet_length(encode(line)) > 300 THEN '[Omitted long matching line]' ELSE line END AS line FROM lines WHERE contains(line, 'tionst')", grep_plan.grep, *W_LINES)
_grep("grep_max_count", ["-m", "2", "the"], "SELECT doc_id, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS r FROM lines WHERE contains(line, 'the')) WHERE r <= 2", grep_plan.grep, *W_LINES)
_grep("grep_only_matching", ["-o", "tion[a-z]+"], "SELECT doc_id, line_no, (n - 1)::INT AS number, match FROM (SELECT doc_id, line_no, unnest(generate_series(1, len(m))) AS n, unnest(m) AS match FROM (SELECT *, regexp_extract_all(line, 'tion[a-z]+') AS m FROM lines))", grep_plan.only_matching)
_grep("grep_count", ["-c", "the"], "SELECT doc_id, count(*) AS n FROM lines WHERE contains(line, 'the') GROUP BY doc_id", grep_plan.count_lines)
_grep("grep_count_matches", ["--count-matches", "the"], "SELECT doc_id, sum(len(regexp_extract_all(line, 'the')))::BIGINT AS n FROM lines WHERE contains(line, 'the') GROUP BY doc_id", grep_plan.count_matches)
_grep("grep_files_with", ["-l", "tionst"], "SELECT DISTINCT doc_id FROM lines WHERE contains(line, 'tionst')", grep_plan.files_with)
_grep("grep_files_without", ["--files-without-match", "tionst"], "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM lines WHERE contains(line, 'tionst'))", grep_plan.files_without)
_grep("grep_include_zero", ["-c", "--include-zero", "tionst"], "SELECT d.doc_id, count(l.line) AS n FROM documents d LEFT JOIN (SELECT * FROM lines WHERE contains(line, 'tionst')) l USING (doc_id) GROUP BY d.doc_id", grep_plan.count_lines)
_CONTEXT_SQL = """, h AS (SELECT *, contains(line, 'tionst') AS hit FROM lines),
n AS (SELECT *, max(hit::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near FROM h),
g AS (SELECT *, CASE WHEN line_no - lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) <= 1 THEN 0 ELSE 1 END AS fresh FROM n WHERE near = 1)
SELECT doc_id, line_no, line, hit AS selected, sum(fresh) OVER (PARTITION BY doc_id ORDER BY line_no)::BIGINT AS island FROM g"""
_grep("grep_context", ["-A", "2", "-B", "1", "tionst"], _CONTEXT_SQL, grep_plan.with_context)
_grep("grep_summary", ["tionst"], ", m AS (SELECT doc_id, count(*) AS l, sum(len(regexp_extract_all(line, 'tionst'))) AS k FROM lines WHERE contains(line, 'tionst') GROUP BY doc_id) SELECT count(*) AS searches, count(l) AS searches_with_match, sum(l)::BIGINT AS matched_lines, sum(k)::BIGINT AS matches, sum(octet_length(encode(text)))::BIGINT AS bytes_searched FROM documents LEFT JOIN m USING (doc_id)", grep_plan.summary)


@query("grep_html_multiline", "SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<title>[^<]*</title>')) FROM pages) GROUP BY page_id")
def _grep_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return grep_plan.multiline(pages, grep_plan.parse(["-U", "<title>[^<]*</title>"]), "page_id", "html").groupBy("page_id").agg(F.sum("n_matches").alias("n"))


@query("grep_multiline")
def _grep_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep_plan.multiline(_docs(spark, sf_dir), grep_plan.parse(["-U", "\\.\\nThe"]))


@query("grep_json_events")
def _grep_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = catalog.corpus_files(spark, sf_dir).select("doc_id", "path").join(_docs(spark, sf_dir), "doc_id")
    return grep_plan.json_events(docs, grep_plan.parse(["--json", "-C1", "tionst"]))


@query("grep_conversation_turns", "SELECT conv_id, turn, role FROM conversations WHERE regexp_matches(text, '(?m)^The')")
def _grep_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return grep_plan.files_with(rows, grep_plan.parse(["-l", "^The"]), ["conv_id", "turn", "role"])


@query("files_sorted", f"WITH {FILES} SELECT path FROM files ORDER BY mtime_s, mtime_ns, path")
def _files_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep_plan.names(catalog.corpus_files(spark, sf_dir), grep_plan.parse(["--files", "--sort", "modified"]))


@query("glob_select", f"WITH {FILES} SELECT path FROM files WHERE regexp_matches(name, '^doc_(1|2)[^/]*$') AND NOT starts_with(path, '/corpus/src3/')")
def _glob_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep_plan.names(catalog.corpus_files(spark, sf_dir), grep_plan.parse(["--files", "-g", "doc_{1,2}*", "-g", "!/src3/**"]))


@query("type_select", f"WITH {FILES} SELECT path FROM files WHERE ends_with(name, '.txt')")
def _type_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep_plan.names(catalog.corpus_files(spark, sf_dir), grep_plan.parse(["--files", "-t", "txt", "-T", "rust"]))


_SPECIAL = "kind = 'symlink'"


def _tree_find(name: str, args: list[str], sql: str, followed: bool = False, mounts: bool = False, column: str = "path") -> None:
    @query(name, f"WITH {TREE} {sql}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        entries = catalog.corpus_entries(spark, sf_dir)
        if mounts:
            entries = find_plan.with_names(entries, mounts=spark.createDataFrame([(1, "ext4"), (2, "tmpfs")], "dev long, name string"))
        if followed:
            entries = find_plan.with_followed(entries)
        return find_plan.find(entries, args, _context()).select(column)


_tree_find("find_xtype_dir", ["-xtype", "d"], "SELECT path FROM entries WHERE kind = 'dir' OR name IN ('x0', 'x10', 'x20')", followed=True)
_tree_find("find_xtype_link", ["-xtype", "l"], "SELECT path FROM entries WHERE name IN ('x5', 'x15')", followed=True)
_tree_find("find_lname", ["-lname", "/corpus/src*"], "SELECT path FROM entries WHERE kind = 'symlink' AND starts_with(target, '/corpus/src')")
_tree_find("find_ilname", ["-ilname", "X*"], "SELECT path FROM entries WHERE kind = 'symlink' AND starts_with(target, 'x')")
_tree_find("find_fstype", ["-fstype", "tmpfs"], "SELECT path FROM entries WHERE dev = 2", mounts=True)
_tree_find("find_printf_links", ["-type", "l", "-printf", "%p %y %Y %l %F\\n"], "SELECT path || ' l ' || CASE name WHEN 'x5' THEN 'N' WHEN 'x15' THEN 'L' ELSE 'd' END || ' ' || target || CASE dev WHEN 1 THEN ' ext4' ELSE ' tmpfs' END || chr(10) AS record FROM entries WHERE kind = 'symlink'", followed=True, mounts=True, column="record")
_tree_find("find_printf_numbers", ["-type", "f", "-printf", "%D %i %n %b %k %04m"], "SELECT dev || ' ' || ino || ' ' || nlink || ' ' || (size + 1023) // 1024 * 2 || ' ' || (size + 1023) // 1024 || ' ' || lpad(printf('%o', mode), 4, '0') AS record FROM entries WHERE kind = 'file'", column="record")
_tree_find("find_special_types", ["-type", "p,s,b,c", "-print0"], "SELECT path || chr(0) AS record FROM entries WHERE kind IN ('fifo', 'socket', 'block', 'character')", column="record")
_tree_find("find_no_operations", ["-noleaf", "-warn", "-ignore_readdir_race", "-name", "x1*"], "SELECT path FROM entries WHERE starts_with(name, 'x1')")
_tree_find("find_links_count", ["-links", "+1", "-type", "f"], "SELECT path FROM entries WHERE nlink > 1 AND kind = 'file'")
_find("find_dialect_grep", ["-regextype", "grep", "-regex", ".*/doc_\\(1\\|22\\)[0-9]*[.]rs"], "regexp_matches(path, '^.*/doc_(1|22)[0-9]*[.]rs$')")
_find("find_dialect_awk", ["-regextype", "posix-awk", "-regex", ".*/doc_(1|22)[0-9]+[.]rs"], "regexp_matches(path, '^.*/doc_(1|22)[0-9]+[.]rs$')")
_find("find_dialect_egrep", ["-regextype", "egrep", "-regex", ".*/(de|es)/doc_[0-9]+5?[.]txt"], "regexp_matches(path, '^.*/(de|es)/doc_[0-9]+5?[.]txt$')")
_find("find_dialect_basic", ["-regextype", "posix-basic", "-regex", ".*/doc_[0-9]\\{2\\}[.]txt"], "regexp_matches(path, '^.*/doc_[0-9]{2}[.]txt$')")
_find("find_regex_backreference", ["-regextype", "posix-extended", "-regex", ".*/doc_([0-9])[0-9]*\\1[.]txt"], "regexp_matches(name, '^doc_[0-9]{2,}[.]txt$') AND name[5:5] = regexp_extract(name, '([0-9])[.]txt$', 1)")


@query("find_printf_times", f"WITH {FILES} SELECT strftime(t, '%a %b ') || lpad(day(t)::VARCHAR, 2, ' ') || strftime(t, ' %H:%M:%S.') || lpad(mtime_ns::VARCHAR, 9, '0') || '0' || strftime(t, ' %Y') || '|' || strftime(t, '%G-W%V-%u %j %U %W') AS record FROM (SELECT *, make_timestamp(mtime_s * 1000000) AS t FROM files)")
def _find_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_plan.find(catalog.corpus_files(spark, sf_dir), ["-printf", "%t|%TG-W%TV-%Tu %Tj %TU %TW"], _context()).select("record")


@query("find_quit_after_prints", f"WITH {FILES}, o AS (SELECT *, string_split(path, '/') AS k FROM files) SELECT path FROM o WHERE contains(name, '1') AND k <= (SELECT min(k) FROM o WHERE contains(name, '99') AND NOT contains(name, '1')) ORDER BY k")
def _find_quit_later(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_plan.paths(catalog.corpus_files(spark, sf_dir), ["-name", "*1*", "-print", "-o", "-name", "*99*", "-quit"], _context())


@query("find_execdir", f"WITH {FILES} SELECT parent, count(*) AS n, min('./' || name) AS first FROM files GROUP BY parent")
def _find_execdir(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_plan.find(catalog.corpus_files(spark, sf_dir), ["-execdir", "cat", "{}", "+"], _context())
    rows = find_plan.exec_batches(found, ["cat", "{}"], 1 << 30, in_directory=True)
    return rows.select("parent", F.size("arguments").cast("long").alias("n"), F.col("arguments")[0].alias("first"))


@query("link_targets", f"WITH {TREE} SELECT path, CASE name WHEN 'x5' THEN NULL WHEN 'x15' THEN 'loop' ELSE 'dir' END AS follow_kind FROM entries WHERE kind = 'symlink'")
def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_plan.with_followed(catalog.corpus_entries(spark, sf_dir)).filter("kind = 'symlink'").select("path", "follow_kind")


@query("path_to_id", f"WITH {FILES} SELECT path, 1 AS dev, ino, doc_id FROM files WHERE doc_id % 9 = 0 UNION ALL SELECT '/corpus/none', NULL, NULL, NULL")
def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = catalog.corpus_files(spark, sf_dir)
    asked = files.filter("doc_id % 9 = 0").select("path").union(spark.createDataFrame([("/corpus/none",)], "path string"))
    return catalog.ids_of(files, asked)


@query("search_limit", f"WITH {FILES} {HIT} WHERE size > 2048 ORDER BY parent, name LIMIT 15")
def _search_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_plan.search(catalog.corpus_files(spark, sf_dir), None, ["size:>2k"], NOW, limit=15)


_BAD = [(["("], "missing-operand"), (["(", "a"], "unclosed-group"), (["a", ")"], "unopened-group"), (["size:x"], "bad-size"), (["mtime:3d"], "bad-age"), (["type:q"], "bad-type"), (["re:("], "bad-regex"), (["ext:"], "empty-value"), (["case:"], "empty-case"), (["a OR b"], "embedded-operator"), (["name-term:a b"], "bad-token"), (["text:--"], "no-token"), (["size:99999999999t"], "size-overflow"), (["ext:a/b"], "bad-extension")]


@query("search_errors", "SELECT * FROM (VALUES " + ", ".join(f"('{' '.join(a)}', '{k}')" for a, k in _BAD) + ") AS t(query, kind)")
def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kind(args: list[str]) -> str:
        try:
            search_plan.parse(args)
        except search_plan.SearchError as e:
            return e.kind
        return "none"

    return spark.createDataFrame([(" ".join(a), kind(a)) for a, _ in _BAD], "query string, kind string")


_REFUSED = [("find", ["-context", "x"]), ("find", ["-files0-from", "x"]), ("find", ["-printf", "%Z"]), ("find", ["-regextype", "none", "-name", "x"]), ("grep", ["--pcre2", "x"]), ("grep", ["--pre", "x", "y"]), ("grep", ["--sort", "path", "x"]), ("grep", ["-z", "x"]), ("find", ["-name", "x"]), ("grep", ["x"])]


@query("refused_arguments", "SELECT * FROM (VALUES " + ", ".join(f"('{lang}', '{' '.join(a)}', {'FALSE' if a[-1] == 'x' and len(a) < 3 and a[0] in ('-name', 'x') else 'TRUE'})" for lang, a in _REFUSED) + ") AS t(language, arguments, refused)")
def _refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    def refused(language: str, args: list[str]) -> bool:
        try:
            if language == "grep":
                grep_plan.parse(args)
            else:
                find_plan.compile_expression(plan := find_plan.parse(args), _context())
                for action in (x[1] for x in _nodes(plan.expression) if x[0] == "action" and x[1].kind == "printf"):
                    compile_format(action.argument)
        except ValueError:
            return True
        return False

    return spark.createDataFrame([(lang, " ".join(a), refused(lang, a)) for lang, a in _REFUSED], "language string, arguments string, refused boolean")


def _nodes(node: tuple) -> list[tuple]:
    return [node, *(n for x in node[1:] if isinstance(x, tuple) for n in _nodes(x))]


# ── more of the line search ──


@query("grep_quiet", f"WITH {LINES} SELECT count(*) FILTER (contains(line, 'tionst')) > 0 AS found, count(*) FILTER (contains(line, 'xylophonexylophone')) > 0 AS absent FROM lines")
def _grep_quiet(spark: SparkSession, sf_dir: str) -> DataFrame:
    ask = lambda p: grep_plan.exists(_docs(spark, sf_dir), grep_plan.parse(["-q", p]), ["doc_id"])
    return spark.createDataFrame([(ask("tionst"), ask("xylophonexylophone"))], "found boolean, absent boolean")


@query("grep_dotall", "SELECT doc_id, len(regexp_extract_all(text, '(?s)[.].The'))::BIGINT AS n FROM documents WHERE regexp_matches(text, '(?s)[.].The')")
def _grep_dotall(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grep_plan.multiline(_docs(spark, sf_dir), grep_plan.parse(["-U", "--multiline-dotall", "[.].The"]))
    return found.groupBy("doc_id").agg(F.sum("n_matches").alias("n"))


def _with_nul(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document with a NUL behind its first 80 characters."""
    cut = F.concat(F.substring("text", 1, 80), F.decode(F.unhex(F.lit("00")), "UTF-8"), F.expr("substring(text, 81)"))
    return _docs(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 3 == 0, cut).otherwise(F.col("text")))


@query("grep_binary", """SELECT doc_id, 'binary file matches (found "\\0" byte around offset ' || octet_length(encode(text[1:80])) || ')' AS message FROM documents WHERE doc_id % 3 = 0 AND regexp_matches(text[1:80], 'ing')""")
def _grep_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep_plan.binary_documents(_with_nul(spark, sf_dir), grep_plan.parse(["ing"]), ["doc_id"])


_binary = lambda args, sql: query(f"grep_binary_{'text' if '-a' in args else 'lines'}", f"WITH {LINES} SELECT doc_id, count(*) AS n FROM lines WHERE contains(line, 'tionst'){sql} GROUP BY doc_id")(lambda spark, sf_dir: grep_plan.count_lines(_with_nul(spark, sf_dir), grep_plan.parse(args), ["doc_id"]))
_binary(["-c", "tionst"], " AND doc_id % 3 <> 0")


@query("sniff_binary", "SELECT doc_id, doc_id % 3 = 0 AS is_binary FROM documents")
def _sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_nul(spark, sf_dir).select("doc_id", T.is_binary(F.encode("text", "UTF-8")).alias("is_binary"))


@query("grep_bom", f"WITH {LINES} SELECT doc_id, line_no, line FROM lines WHERE regexp_matches(line, '^[A-Z][a-z]+ing') AND line_no = 1")
def _grep_bom(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).withColumn("text", F.concat(F.lit("\ufeff"), "text"))
    return grep_plan.grep(docs, grep_plan.parse(["^[A-Z][a-z]+ing"]), ["doc_id"]).filter("line_no = 1")


@query("grep_empty_matches", f"WITH {LINES} SELECT doc_id, sum(length(line) + 1)::BIGINT AS n FROM lines GROUP BY doc_id")
def _grep_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep_plan.count_matches(_docs(spark, sf_dir), grep_plan.parse(["--count-matches", "\\x02*"]), ["doc_id"])


@query("grep_with_filename", f"WITH {FILES}, {LINES} SELECT path || ':' || line_no || ':' || line AS record FROM lines JOIN files USING (doc_id) WHERE contains(line, 'tionst')")
def _grep_presented(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = catalog.corpus_files(spark, sf_dir).select("doc_id", "path").join(_docs(spark, sf_dir), "doc_id")
    plan = grep_plan.parse(["-H", "-n", "tionst"])
    return grep_plan.presented(grep_plan.grep(docs, plan, ["path"]), plan).select("record")


@query("grep_pattern_file", f"WITH {LINES} {PICK} regexp_matches(line, 'tionst|^Er')")
def _grep_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = grep_plan.parse(["-f", "patterns"], {"patterns": ["tionst\r", "^Er"]}.get)
    return grep_plan.grep(_docs(spark, sf_dir), plan, ["doc_id"]).select(*W_LINES)


@query("grep_one_input", f"WITH {LINES} SELECT line_no, line FROM lines WHERE doc_id = 7 AND contains(line, 'e')")
def _grep_stdin(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one input given by hand, as from a pipe
    content = _docs(spark, sf_dir).filter("doc_id = 7").first().text
    return grep_plan.grep(grep_plan.one_input(spark, content.encode()), grep_plan.parse(["e"]), ["path"]).select("line_no", "line")


@query("files_depth", f"WITH {TREE} SELECT path FROM entries WHERE kind = 'file' AND depth <= 2")
def _files_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep_plan.names(catalog.corpus_entries(spark, sf_dir), grep_plan.parse(["--files", "--max-depth", "2"]))


@query("required_literals", "SELECT * FROM (VALUES ('shing[a-z]*tion', 'shing'), ('^The (a|b) long word$', ' long word'), ('[0-9]+', ''), ('a+bcd?', 'bc')) AS t(pattern, literal)")
def _required(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = ["shing[a-z]*tion", "^The (a|b) long word$", "[0-9]+", "a+bcd?"]
    return spark.createDataFrame([(p, trigram.required_literal(p)) for p in patterns], "pattern string, literal string")


# ── census ──


@query("stats_kinds", f"WITH {TREE} SELECT kind, count(*) AS n FROM entries GROUP BY kind")
def _stats_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.kinds(catalog.corpus_entries(spark, sf_dir))


@query("stats_inodes", f"WITH {TREE} SELECT count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind = 'symlink') AS symlinks, count(*) FILTER (kind IN ('fifo', 'socket', 'block', 'character')) AS specials, count(*) FILTER (kind = 'dir') AS dirs FROM entries")
def _stats_inodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.inode_counts(catalog.corpus_entries(spark, sf_dir))


@query("stats_states", f"WITH {TREE} SELECT state, count(*) AS n, sum(size)::BIGINT AS bytes FROM entries WHERE kind = 'file' GROUP BY state")
def _stats_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.states(catalog.corpus_entries(spark, sf_dir))


@query("stats_ext_top15", "SELECT lower(regexp_extract(u, '(?s)^.+\\.([^.]*)$', 1)) AS ext, count(*) AS files, sum(octet_length(encode(html)))::BIGINT AS bytes FROM (SELECT html, regexp_extract(url, '([^/]*)$', 1) AS u FROM pages) GROUP BY 1 ORDER BY files DESC, ext LIMIT 15")
def _stats_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.regexp_extract("url", "([^/]*)$", 1).alias("name"), F.octet_length("html").cast("long").alias("size"), F.lit("file").alias("kind"))
    return stats.extensions(pages)


@query("stats_histogram", f"WITH {FILES} SELECT CASE WHEN size = 0 THEN 0 ELSE length(bin(size)) END::INT AS bucket, count(*) AS n, sum(size)::BIGINT AS total FROM files GROUP BY 1")
def _stats_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(catalog.corpus_files(spark, sf_dir), "size")


@query("stats_name_lengths", f"WITH {TREE} SELECT length(bin(octet_length(encode(name))))::INT AS bucket, count(*) AS n, sum(octet_length(encode(name)))::BIGINT AS total FROM entries GROUP BY 1")
def _stats_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(catalog.corpus_entries(spark, sf_dir).select(F.octet_length("name").cast("long").alias("bytes")), "bytes")


_PERCENTILE = "SELECT q, value FROM (SELECT unnest([0.5, 0.9, 0.99, 1.0])::DOUBLE AS q) JOIN (SELECT {0} AS value, row_number() OVER (ORDER BY {0}) - 1 AS i, count(*) OVER () AS n FROM {1}) ON i = floor((n - 1) * q + 0.5)::BIGINT"


@query("stats_percentiles", f"WITH {FILES} " + _PERCENTILE.format("size", "files"))
def _stats_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.percentiles(catalog.corpus_files(spark, sf_dir), "size")


@query("stats_price_percentiles", _PERCENTILE.format("l_extendedprice", "lineitem"))
def _stats_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.percentiles(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_extendedprice")


@query("stats_hardlinks", "SELECT count(*) AS inodes, coalesce(sum(n - 1), 0)::BIGINT AS extra_names FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1)")
def _stats_hardlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.lit("file").alias("kind"), F.lit(1).alias("dev"), F.col("o_custkey").alias("ino"))
    return stats.hard_links(names)


@query("stats_duplicates", "SELECT count(*) AS docs, sum(n - 1)::BIGINT AS extra_inodes, sum((n - 1) * size)::BIGINT AS extra_bytes FROM (SELECT count(*) AS n, octet_length(encode(text)) AS size FROM documents GROUP BY text HAVING count(*) > 1)")
def _stats_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.duplicates(_docs(spark, sf_dir))


@query("dedup_by_hash", "SELECT left(sha256(text), 32) AS hash, min(doc_id) AS doc_id, count(*) AS refs FROM documents GROUP BY text")
def _dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.document_ids(_docs(spark, sf_dir))


@query("stats_dangling", "SELECT count(*) AS n FROM events WHERE event_id NOT IN (SELECT doc_id FROM documents)")
def _stats_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("doc_id"))
    return stats.dangling(events, _docs(spark, sf_dir))


@query("stats_live_dead", "SELECT count(*) FILTER (l IS NOT NULL) AS live, count(*) FILTER (l IS NULL) AS dead, max(e.event_id) + 1 AS next_id FROM events e LEFT JOIN (SELECT doc_id AS l FROM documents) ON l = event_id")
def _stats_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("doc_id"))
    return stats.live_dead(events, _docs(spark, sf_dir))


@query("stats_json", f"WITH {TREE} SELECT '{{\"kind\":\"' || kind || '\",\"n\":' || count(*) || '}}' AS value FROM entries GROUP BY kind")
def _stats_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.as_json(stats.kinds(catalog.corpus_entries(spark, sf_dir)))


@query("subtree_counts", f"WITH {TREE} SELECT a.path, count(*) AS n FROM entries a JOIN entries b ON starts_with(b.path, a.path || '/') WHERE a.kind = 'dir' GROUP BY a.path")
def _subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.subtree_counts(catalog.corpus_entries(spark, sf_dir))


@query("tree_paths_recursive", """WITH RECURSIVE edges AS (SELECT 'r' || r_regionkey AS node, NULL AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'order_' || o_orderkey FROM orders),
t AS (SELECT node, '/' || name AS path, 0 AS depth FROM edges WHERE parent IS NULL UNION ALL SELECT e.node, t.path || '/' || e.name, t.depth + 1 FROM edges e JOIN t ON e.parent = t.node) SELECT node, path, depth FROM t""")
def _tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.resolve_paths(catalog.table_tree(spark, sf_dir))


# ── index and sets ──

_TOKENS = "tokens AS (SELECT DISTINCT doc_id, unnest(list_concat(string_split(trim(lower(regexp_replace(text, '[^\\p{L}\\p{N}_]+', ' ', 'g'))), ' '), string_split(trim(lower(regexp_replace(" + UNITS.format("text") + ", '[^\\p{L}\\p{N}]+', ' ', 'g'))), ' '))) AS term FROM documents)"


@query("tokens_census", f"WITH {_TOKENS} SELECT term, count(*) AS df FROM tokens WHERE term <> '' GROUP BY term")
def _tokens_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.terms(index.build(_docs(spark, sf_dir)).postings)


def _sets(name: str, sql: str, combine: Callable) -> None:
    @query(name, f"WITH {_TOKENS} {sql}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _docs(spark, sf_dir)
        built = index.build(docs)
        sure = lambda t: index.documents_with(built.with_terms([t]), t).withColumn("truth", F.lit(True))
        return combine(sure, docs.select("doc_id")).filter("truth").select("doc_id")


_IN = "doc_id IN (SELECT doc_id FROM tokens WHERE term = '{}')"
_sets("postings_and", f"SELECT doc_id FROM documents WHERE {_IN.format('with')} AND {_IN.format('this')}", lambda s, live: index.both(s("with"), s("this")))
_sets("postings_or", f"SELECT doc_id FROM documents WHERE {_IN.format('worthless')} OR {_IN.format('stupid')}", lambda s, live: index.either(s("worthless"), s("stupid")))
_sets("postings_and_not", f"SELECT doc_id FROM documents WHERE {_IN.format('with')} AND NOT {_IN.format('this')}", lambda s, live: index.but_not(s("with"), s("this")))
_sets("postings_not", f"SELECT doc_id FROM documents WHERE NOT {_IN.format('the')}", lambda s, live: index.complement(live, s("the")))


@query("trigram_candidates", "SELECT doc_id FROM documents WHERE contains(lower(text), 'shi') AND contains(lower(text), 'hin') AND contains(lower(text), 'ing') AND contains(lower(text), 'tio') AND contains(lower(text), 'ion')")
def _trigram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.candidates(index.build(_docs(spark, sf_dir)), trigram.derive("shing[a-z]*tion"))


@query("trigram_grep", "SELECT doc_id FROM documents WHERE regexp_matches(text, 'shing[a-z]*tion')")
def _trigram_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    few = index.candidates(index.build(docs), trigram.derive("shing[a-z]*tion"))
    return docs.join(few, "doc_id", "left_semi").filter(F.col("text").rlike("shing[a-z]*tion")).select("doc_id")


@query("trigram_screened", "SELECT doc_id FROM documents WHERE regexp_matches(text, 'tion(st|re)[a-z]*ing')")
def _trigram_screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rarest keys only, then the regex."""
    docs, pattern = _docs(spark, sf_dir), "tion(st|re)[a-z]*ing"
    built, asked = index.build(docs), trigram.derive(pattern)
    few = index.candidates(built, trigram.weaken(asked, index.key_counts(built, asked), rarest=2))
    return docs.join(few, "doc_id", "left_semi").filter(F.col("text").rlike(pattern)).select("doc_id")


@query("tokens_capped", "SELECT doc_id, repeat('é', 32) AS term FROM documents UNION ALL SELECT doc_id, doc_id::VARCHAR FROM documents")
def _tokens_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).withColumn("text", F.concat(F.repeat(F.lit("é"), 40), F.col("doc_id").cast("string")))
    return index.build(docs).postings.select("doc_id", "term")


@query("tokens_without_blobs", f"WITH {_TOKENS} SELECT term, count(*) AS df FROM tokens WHERE term <> '' GROUP BY term")
def _tokens_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).withColumn("text", F.concat("text", F.lit(" x9Kd8QzL2mVb7RtY4wPqS1nH==")))
    return index.terms(index.build(docs, skip_blobs=True).postings)


@query("normalized_tokens", "SELECT p_partkey, CASE WHEN regexp_matches(s, '^[\\p{L}\\p{N}_]+$') THEN lower(s) END AS token FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand ELSE string_split(p_name, ' ')[1] END AS s FROM part)")
def _normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.split("p_name", " ")[0])
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", T.normalized(text).alias("token"))


def _census(name: str, make: Callable, where: str = "TRUE") -> None:
    @query(name, f"WITH {_TOKENS} SELECT term, count(*) AS df FROM tokens WHERE term <> '' AND {where} GROUP BY term")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return index.terms(make(_docs(spark, sf_dir)).postings)


_census("index_follow", lambda docs: index.follow(index.build(docs.filter("doc_id % 3 = 0")), docs))
_census("index_purge", lambda docs: index.purge(index.build(docs), docs.filter("doc_id % 10 <> 7")), "doc_id % 10 <> 7")
_census("index_merge", lambda docs: index.merge([index.build(docs.filter(f"doc_id % 4 in ({k}, 3)")) for k in range(3)], docs.filter("doc_id % 10 <> 7")), "doc_id % 10 <> 7")


@query("dictionary_merge", f"WITH {_TOKENS} SELECT term, count(*)::BIGINT AS df FROM tokens WHERE term <> '' GROUP BY term")
def _dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [index.terms(index.build(_docs(spark, sf_dir).filter(f"doc_id % 3 = {k}")).postings) for k in range(3)]
    return index.merged_dictionary(parts)


@query("index_uncovered", f"WITH {_TOKENS} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN TRUE END AS truth FROM documents WHERE doc_id % 2 = 1 OR {_IN.format('with')}")
def _uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return index.answer(index.build(docs.filter("doc_id % 2 = 0")), search_plan.parse_atom("text:with"), docs.select("doc_id"))


@query("postings_maybe", f"WITH {_TOKENS} SELECT count(*) AS n, count(*) FILTER (doc_id BETWEEN 20 AND 90) AS inside, 0::BIGINT AS sure FROM documents WHERE {_IN.format('with')}")
def _maybe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = index.maybe(index.documents_with(index.build(_docs(spark, sf_dir)).with_terms(["with"]), "with"))
    return rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("doc_id").between(20, 90), 1)).alias("inside"), F.count("truth").alias("sure"))


@query("part_name_tokens", "SELECT token, count(DISTINCT name) AS names FROM (SELECT p_name AS name, unnest(string_split(lower(p_name), ' ')) AS token FROM part) WHERE token <> '' GROUP BY token")
def _part_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = index.name_terms(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("name")))
    return names.groupBy("token").agg(F.count("*").alias("names"))


# ── maintenance ──


def _observed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A snapshot and a later observation: some files gone, some new, some touched."""
    files = catalog.corpus_files(spark, sf_dir)
    old = files.filter("doc_id % 10 <> 3")
    new = files.filter("doc_id % 10 <> 7").withColumn("mtime_s", F.when(F.col("doc_id") % 10 == 5, F.col("mtime_s") + 1).otherwise(F.col("mtime_s")))
    return old, new


@query("reconcile_diff", f"WITH {FILES} SELECT parent, name, CASE doc_id % 10 WHEN 3 THEN 'insert' WHEN 7 THEN 'delete' WHEN 5 THEN 'update' ELSE 'unchanged' END AS kind FROM files")
def _reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.diff(*_observed(spark, sf_dir))


@query("change_records", f"WITH {FILES} SELECT CASE doc_id % 10 WHEN 3 THEN 'NamePut' ELSE 'NameDelete' END AS kind, path AS key FROM files WHERE doc_id % 10 IN (3, 7) UNION ALL SELECT 'InodePut', '1:' || ino FROM files WHERE doc_id % 10 IN (3, 5)")
def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.change_records(*_observed(spark, sf_dir)).select("kind", "key")


@query("carry_over", f"WITH {FILES} SELECT path, doc_id % 10 NOT IN (3, 5) AS carried, CASE WHEN doc_id % 10 NOT IN (3, 5) THEN doc_id END AS carried_doc FROM files WHERE doc_id % 10 <> 7")
def _carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _observed(spark, sf_dir)
    with_hash = lambda df: df.withColumn("hash", F.md5(F.col("path").cast("binary")))
    return reconcile.carry_over(with_hash(new), with_hash(old)).select("path", "carried", "carried_doc")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", "delete").otherwise("put").alias("kind"), "value")


@query("log_replay_latest", "SELECT user_id AS id, event_id AS seq, CASE WHEN event_type = 'click' THEN 'delete' ELSE 'put' END AS kind, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def _replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.latest(_log(spark, sf_dir))


@query("overlay_view", "WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) SELECT c_custkey AS id, c_acctbal AS value FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM l) UNION ALL SELECT user_id, value FROM l WHERE event_type <> 'click'")
def _overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    return reconcile.overlay(base, _log(spark, sf_dir))


@query("assign_documents", "WITH h AS (SELECT DISTINCT sha256(text) AS hash FROM documents), live AS (SELECT sha256(text) AS hash, min(doc_id) AS doc_id FROM documents WHERE doc_id % 2 = 0 GROUP BY 1) SELECT hash, coalesce(doc_id, 1000000 + row_number() OVER (PARTITION BY doc_id IS NULL ORDER BY md5(hash)[:3], hash) - 1)::BIGINT AS doc_id FROM h LEFT JOIN live USING (hash)")
def _assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = _docs(spark, sf_dir).select(F.sha2("text", 256).alias("hash"), "doc_id")
    live = hashed.filter("doc_id % 2 = 0").groupBy("hash").agg(F.min("doc_id").alias("doc_id"))
    return reconcile.assign_documents(hashed, live, live.limit(0), 1_000_000)


@query("ignore_decisions", f"WITH {TREE} SELECT path, CASE WHEN regexp_matches(path, '/de/') AND NOT starts_with(path, '/corpus/src1/') THEN 'unvisited' WHEN regexp_matches(path, '/de/') AND NOT regexp_matches(name, '7[.]txt$') THEN 'skip' WHEN path = '/corpus/src1/de' THEN 'traverse' WHEN kind = 'dir' AND name = 'de' THEN 'skip' WHEN kind = 'dir' THEN 'descend' WHEN kind = 'symlink' THEN 'symlink' WHEN kind <> 'file' THEN 'special' WHEN regexp_matches(name, '7[.]txt$') AND NOT starts_with(path, '/corpus/src1/') THEN 'skip' WHEN size > 4096 THEN 'too-large' ELSE 'index' END AS decision FROM entries WHERE depth > 0")
def _ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ignore.rules(spark, [("/corpus", ".gitignore", ["de/", "*7.txt"]), ("/corpus/src1", ".siftignore", ["!*7.txt"])], "/corpus")
    return ignore.decide(catalog.corpus_entries(spark, sf_dir).filter("depth > 0"), rows, 4096).select("path", "decision")


@query("reconcile_inodes", f"WITH {FILES} SELECT 1 AS dev, ino, CASE doc_id % 10 WHEN 3 THEN 'insert' WHEN 7 THEN 'delete' WHEN 5 THEN 'update' ELSE 'unchanged' END AS kind FROM files")
def _reconcile_inodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.diff_inodes(*_observed(spark, sf_dir))


@query("rename_pairs", "SELECT a.event_id // 2 AS cookie, '/d' || a.user_id || '/' || a.event_type AS old_path, '/d' || b.user_id || '/' || b.event_type AS new_path FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.event_id % 2 = 0")
def _renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return reconcile.rename_pairs(events.select(F.floor(F.col("event_id") / 2).alias("cookie"), F.when(F.col("event_id") % 2 == 0, "moved_from").otherwise("moved_to").alias("mask"), F.concat(F.lit("/d"), F.col("user_id").cast("string")).alias("dir"), F.col("event_type").alias("name")))


@query("repositories", "SELECT s_nationkey AS common_dev, s_nationkey % 2 AS common_ino, count(*) AS n FROM supplier GROUP BY s_nationkey")
def _repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_nationkey").alias("common_dev"), (F.col("s_nationkey") % 2).alias("common_ino"), F.col("s_name").alias("dir"))
    return reconcile.repositories(trees).drop("dirs")


@query("log_budgets", "SELECT count(*) AS records, 100.0 * count(DISTINCT user_id) / 1000 AS dirty_percent, 100.0 * count(*) FILTER (event_type = 'click') / 1000 AS dead_percent FROM events")
def _budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir).withColumn("kind", F.when(F.col("kind") == "delete", "NameDelete").otherwise("NamePut"))
    return stats.budgets(log, 1000)


@query("batch_requests", "SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN 'malformed' WHEN conv_id % 5 = 1 THEN 'unknown-op' END AS error, CASE WHEN conv_id % 5 <> 0 THEN role END AS first FROM conversations")
def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    op = F.when(F.col("conv_id") % 5 == 1, "erase").otherwise("grep")
    line = F.when(F.col("conv_id") % 5 == 0, "not json").otherwise(F.to_json(F.struct(F.col("turn").cast("string").alias("id"), op.alias("op"), F.array("role", "text").alias("args"))))
    found = catalog.batch_requests(rows.select("conv_id", "turn", line.alias("value")), keep=["conv_id", "turn"])
    return found.select("conv_id", "turn", "error", F.col("request.args")[0].alias("first"))


@query("hash_sample", "SELECT doc_id FROM documents WHERE ('0x' || md5(doc_id::VARCHAR)[1:8])::BIGINT % 8 = 0")
def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.sample(_docs(spark, sf_dir), "doc_id", 8).select("doc_id")


@query("pretty_sizes", f"WITH {FILES} SELECT path, CASE WHEN size >= 1048576 THEN (size * 10 + 524288) // 1048576 // 10 || '.' || (size * 10 + 524288) // 1048576 % 10 || ' MiB' WHEN size >= 1024 THEN (size * 10 + 512) // 1024 // 10 || '.' || (size * 10 + 512) // 1024 % 10 || ' KiB' ELSE size || ' B' END AS shown FROM files")
def _pretty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.corpus_files(spark, sf_dir).select("path", stats.pretty_bytes(F.col("size")).alias("shown"))


@query("bytes_json", "SELECT doc_id, coalesce(try(decode(b)), decode(b[1:19]) || chr(65533)) AS name, CASE WHEN try(decode(b)) IS NULL THEN base64(b) END AS name_base64 FROM (SELECT doc_id, encode(text)[1:20] AS b FROM documents)")
def _bytes_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", F.substring(F.encode("text", "UTF-8"), 1, 20).alias("b"))
    return rows.select("doc_id", *T.bytes_fields(F.col("b"), "name"))


_BAND = "CASE WHEN kind = 'dir' THEN 'descend' WHEN kind = 'symlink' THEN 'symlink' WHEN kind <> 'file' THEN 'special' WHEN name = 'doc_15.rs' THEN 'skip' WHEN ends_with(name, '5.rs') THEN 'index' WHEN ends_with(name, '.rs') THEN 'skip' ELSE 'index' END"


@query("ignore_bands", f"WITH {TREE} SELECT path, {_BAND} AS decision FROM entries WHERE depth > 0")
def _bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Higher bands decide over lower ones; the defaults exclude nothing here."""
    rows = ignore.rules(spark, [("", "global", ignore.DEFAULTS), ("/corpus", ".gitignore", ["*.rs"]), ("/corpus", ".ignore", ["!*5.rs"]), ("/corpus", ".siftignore", ["doc_15.rs"])], "/corpus")
    return ignore.decide(catalog.corpus_entries(spark, sf_dir).filter("depth > 0"), rows, 1 << 40).select("path", "decision")


@query("stream_bursts")
def _bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select(F.col("user_id").cast("string").alias("root"), (F.unix_millis(F.col("ts").cast("timestamp")) % 5000).alias("ms"), F.col("event_type").alias("scope"))
    return feeds.bursts(rows)


@query("limit_topk", f"WITH {FILES} SELECT path, size FROM files ORDER BY size DESC, path LIMIT 20")
def _topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.corpus_files(spark, sf_dir).select("path", "size").orderBy(F.desc("size"), "path").limit(20)


@query("line_tokens", f"WITH {LINES} SELECT doc_id, line_no, len(regexp_extract_all(line, '[\\p{{L}}\\p{{N}}_]+'))::INT AS n FROM lines")
def _line_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep_plan.lines_of(_docs(spark, sf_dir), ["doc_id"]).select("doc_id", "line_no", F.size(T.runs(F.col("line"))).alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A boolean search over names, metadata and text."""
    return search_plan.search(catalog.corpus_files(spark, sf_dir), _docs(spark, sf_dir), ["text:the", "ext:txt", "size:>1k", "NOT", "name:doc_1"], NOW)


query("flagship_search", f"WITH {FILES} {HIT} WHERE {_term('the')} AND size > 1024 AND NOT contains(name, 'doc_1') AND ends_with(name, '.txt')")(flagship)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
