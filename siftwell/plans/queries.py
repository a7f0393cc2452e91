"""The registered screening queries and their DuckDB SQL, side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import contracts
from siftwell.functions.contracts import Pattern, Source, thresholds
from siftwell.operators import backends, classify, discovery, evidence, redaction, review, tables
from siftwell.sources import providers, python_handlers, tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"))


# -- redaction, also the first step of every screen

_EDGE_NAMES = r"(?:api[_-]?key|access[_-]?token|auth[_-]?token|token|secret|passw(?:or)?d|client[_-]?secret|credential)"
_NAMED = rf"(?i)\b({_EDGE_NAMES})\b(\s*[:=]\s*)"
_STEPS = [  # RE2 has no back references: the quoted rule comes as two, of which no text position can take both
    (r"-----BEGIN (?:[A-Z0-9]+ )?PRIVATE KEY-----[\s\S]*?-----END (?:[A-Z0-9]+ )?PRIVATE KEY-----", "[REDACTED_PRIVATE_KEY]"),
    (r"(?i)\bBearer\s+[-\w.~+/]{12,}={0,2}", "Bearer [REDACTED]"),
    (r"\b(?:sk-(?:ant-)?|gh[oprsu]_|github_pat_|xox[abprs]-)[-\w.]{12,}\b", "[REDACTED_TOKEN]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED_AWS_ACCESS_KEY]"),
    (r"\bAIza[-\w]{30,}\b", "[REDACTED_API_KEY]"),
    (_NAMED + r'"([^"\x27\r\n]{6,})"', r'\1\2"[REDACTED]"'),
    (_NAMED + r"\x27([^\"\x27\r\n]{6,})\x27", r"\1\2''[REDACTED]''"),
    (_NAMED + r"([^\s,;]{8,})", r"\1\2[REDACTED]"),
]


def _redaction_ctes(base: str) -> str:
    """CTEs r0 to r8 over a query of (key, text): each step counts, then replaces. The last is ``red`` (key, text, n)."""
    ctes = [f"r0 AS (SELECT key, text, 0::BIGINT AS n FROM ({base}))"]
    for i, (pattern, to) in enumerate(_STEPS):
        ctes.append(f"r{i + 1} AS (SELECT key, regexp_replace(text, '{pattern}', '{to}', 'g') AS text, n + len(regexp_extract_all(text, '{pattern}')) AS n FROM r{i})")
    return ",\n".join([*ctes, f"red AS (SELECT key, text, n FROM r{len(_STEPS)})"])


_DOCS_RED = _redaction_ctes("SELECT doc_id AS key, coalesce(text, '') AS text FROM documents")


def _redacted(items: DataFrame) -> DataFrame:
    return redaction.redacted(items.select("ord", "id", "text"), count="n")


@query(f"WITH {_DOCS_RED} SELECT key AS doc_id, md5(text) AS text_md5, CAST(n AS BIGINT) AS n FROM red")
def redact_text(spark, sf_dir):
    return _redacted(_items(spark, sf_dir)).select(F.col("ord").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("text_md5"), "n")


@query(
    "WITH "
    + _redaction_ctes("SELECT role AS key, coalesce(text, '') AS text FROM conversations UNION ALL SELECT 'document', coalesce(text, '') FROM documents")
    + " SELECT key AS role, count(*) AS items, CAST(count(*) FILTER (n > 0) AS BIGINT) AS redacted_items, CAST(sum(n) AS BIGINT) AS redaction_count FROM red GROUP BY key"
)
def redact_counts(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select("role", "text").unionByName(_table(spark, sf_dir, "documents").select(F.lit("document").alias("role"), "text"))
    rows = redaction.redacted(rows.select("role", F.coalesce("text", F.lit("")).alias("text")), count="n")
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("n") > 0).alias("redacted_items"), F.sum("n").alias("redaction_count"))


# -- screening

PRIMARY, REFINE = "primary-question", "refinement-question"
ASYM, SYM, REFINED = thresholds(keep=0.7, drop=0.2), thresholds(0.7), thresholds(keep=0.75, drop=0.2)


def _p(contract: str, key: str = "id", text: str = "text") -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '{contract}', {key}, {text})), 1, 8))::BIGINT / 4294967296::DOUBLE)"


def _bucket(limits: contracts.Thresholds, p: str = "p") -> str:
    return f"CASE WHEN {p} >= {limits.keep!r}::DOUBLE THEN 'kept' WHEN {p} <= {limits.drop!r}::DOUBLE THEN 'dropped' ELSE 'undecided' END"


_SCORED = f"WITH {_DOCS_RED},\nscored AS (SELECT key AS ord, key::VARCHAR AS id, text, {_p(PRIMARY, 'key::VARCHAR')} AS p FROM red),\nout AS (SELECT ord, id, text, {_bucket(ASYM)} AS bucket, p AS probability FROM scored)\n"


def _screened(spark, sf_dir, limits=ASYM, contract=PRIMARY):
    return classify.screen(_redacted(_items(spark, sf_dir)).drop("n"), classify.hash_scorer(contract), limits)


@query(_SCORED + "SELECT ord, id, bucket, probability, NULL::VARCHAR AS reason FROM out")
def screen_outcomes(spark, sf_dir):
    return _screened(spark, sf_dir)


_COUNTS = ", ".join(f"CAST(count(*) FILTER (bucket = '{b}') AS BIGINT) AS {b}" for b in classify.BUCKETS)


@query(_SCORED + f"SELECT count(*) AS total, {_COUNTS} FROM out")
def screen_summary(spark, sf_dir):
    return classify.summary(_screened(spark, sf_dir))


_EFF = """SELECT total, dropped, total - dropped AS retained, dropped AS review_avoided, cache_hits, CASE WHEN total > 0 THEN dropped / total::DOUBLE ELSE 0 END AS reduction_rate,
CASE WHEN total > 0 THEN dropped / total::DOUBLE ELSE 0 END AS review_avoidance_rate, CASE WHEN total > 0 THEN cache_hits / total::DOUBLE ELSE 0 END AS cache_hit_rate FROM n"""


@query(_SCORED + ", n AS (SELECT count(*) AS total, CAST(count(*) FILTER (bucket = 'dropped') AS BIGINT) AS dropped, 0::BIGINT AS cache_hits FROM out) " + _EFF)
def screen_efficiency(spark, sf_dir):
    return classify.efficiency(_screened(spark, sf_dir))


def _edge_sql(limits):
    return f"SELECT doc_id AS id, {_bucket(limits, '((doc_id % 101)::DOUBLE / 100)')} AS bucket FROM documents"


def _edges(spark, sf_dir, limits):
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), classify.bucket_of((F.col("doc_id") % 101).cast("double") / 100, limits).alias("bucket"))


@query(_edge_sql(SYM))
def thresholds_symmetric(spark, sf_dir):
    return _edges(spark, sf_dir, SYM)


@query(_edge_sql(ASYM))
def thresholds_asymmetric(spark, sf_dir):
    return _edges(spark, sf_dir, ASYM)


@query(_SCORED + f"SELECT ord, id, CASE WHEN ceil((length(text) + 120) / 4.0) > 1700 THEN 'withheld' ELSE bucket END AS bucket, CASE WHEN ceil((length(text) + 120) / 4.0) > 1700 THEN NULL ELSE probability END AS probability, CASE WHEN ceil((length(text) + 120) / 4.0) > 1700 THEN 'too_large' END AS reason FROM out")
def too_large_withheld(spark, sf_dir):
    return classify.screen(_redacted(_items(spark, sf_dir)).drop("n"), classify.hash_scorer(PRIMARY), ASYM, context_window=2000, overhead=120)


@query(
    f"""WITH s AS (SELECT doc_id AS ord, doc_id::VARCHAR AS id, {_p(PRIMARY, 'doc_id::VARCHAR', "coalesce(text, '')")} AS p, doc_id % 10 AS k FROM documents)
SELECT ord, id, CASE WHEN k < 5 THEN 'errors' ELSE {_bucket(ASYM)} END AS bucket, CASE WHEN k >= 5 THEN p END AS probability,
CASE k WHEN 0 THEN 'classifier_error' WHEN 1 THEN 'aborted' WHEN 2 THEN 'malformed_answer' WHEN 3 THEN 'classifier_exception' WHEN 4 THEN 'malformed_answer' END AS reason FROM s"""
)
def error_taxonomy(spark, sf_dir):
    def scorer(id_, text):
        k, p = id_.cast("long") % 10, classify.hash_probability(PRIMARY, id_, text)
        stop = F.when(k == 0, "error").when(k == 1, "aborted").when(k == 3, "exception").otherwise("stop")
        return classify.answer(F.when(k == 4, F.lit(float("nan"))).otherwise(p), stop, F.when(k == 2, "text").otherwise("bool"))

    return classify.screen(_items(spark, sf_dir), scorer, ASYM)


@query("SELECT doc_id AS ord, doc_id::VARCHAR AS id, 'withheld' AS bucket, NULL::DOUBLE AS probability, 'approval_required' AS reason FROM documents")
def guard_approval(spark, sf_dir):
    return classify.screen(_items(spark, sf_dir), classify.hash_scorer(PRIMARY), ASYM, confirm=False, call_limit=100)


@query("SELECT source, count(*) AS n, CASE WHEN count(*) > 45 THEN 'approval_required' ELSE 'ok' END AS status FROM documents GROUP BY source")
def preflight(spark, sf_dir):
    n = _table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return n.select("source", "n", classify.preflight_status(F.col("n"), 45).alias("status"))


@query("SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 7 = 0 THEN 'missing' ELSE 'repeated' END AS issue FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 0")
def accounting_partition(spark, sf_dir):
    items = _items(spark, sf_dir)
    out = _screened(spark, sf_dir).where("ord % 7 <> 0")
    return classify.accounting_issues(items, out.unionByName(out.where("ord % 11 = 0")))


@query("SELECT lang, count(*) AS calls, CAST(count(*) FILTER (doc_id % 9 <> 0) AS BIGINT) AS usage_reported_calls, count(*) = count(*) FILTER (doc_id % 9 <> 0) AS complete, CAST(coalesce(sum(n_chars) FILTER (doc_id % 9 <> 0), 0) AS BIGINT) AS input FROM documents GROUP BY lang")
def usage_rollup(spark, sf_dir):
    calls = _table(spark, sf_dir, "documents").select("lang", F.when(F.col("doc_id") % 9 != 0, F.col("n_chars")).alias("input"))
    return classify.usage_rollup(calls, ("input",), by=("lang",))


@query(_SCORED + "SELECT id, bucket, CAST(CASE bucket WHEN 'kept' THEN 0 ELSE 1 END AS INTEGER) AS bucket_rank FROM out WHERE bucket <> 'dropped'")
def retained_ids(spark, sf_dir):
    return classify.retained(_screened(spark, sf_dir)).select("id", "bucket", "bucket_rank")


_DROP = f"{ASYM.drop:.6f}"


@query(_SCORED + f"SELECT ord, id, 'DROP' AS label, 1::DOUBLE - probability AS confidence, printf('keepProbability %.6f <= drop threshold {_DROP}', probability) AS reason FROM out WHERE bucket = 'dropped'")
def primary_manifest(spark, sf_dir):
    return classify.manifest(_screened(spark, sf_dir), ASYM, ("DROP",))


@query(_SCORED + ", k AS (SELECT ord, row_number() OVER (ORDER BY ord) AS rn, CASE bucket WHEN 'kept' THEN 'KEEP' WHEN 'dropped' THEN 'DROP' ELSE 'UNDECIDED' END AS label FROM out) SELECT ord, label FROM k WHERE rn > 100 AND rn <= 200")
def manifest_page(spark, sf_dir):
    return classify.page(classify.manifest(_screened(spark, sf_dir), ASYM), ["ord"], 100, 100).select("ord", "label")


_REFINED = _SCORED + f", kept AS (SELECT id, {_p(REFINE)} AS q FROM out WHERE bucket <> 'dropped'), n AS (SELECT count(*) AS retained, CAST(count(*) FILTER ({_bucket(REFINED, 'q')} = 'dropped') AS BIGINT) AS dropped FROM kept)\n"


@query(_REFINED + "SELECT retained, dropped, CASE WHEN retained > 0 THEN dropped / retained::DOUBLE ELSE 0 END AS refinement_yield, coalesce(dropped / nullif(retained, 0)::DOUBLE, 0) < 0.3::DOUBLE AS low_yield FROM n")
def refinement_yield(spark, sf_dir):
    red = _redacted(_items(spark, sf_dir)).drop("n")
    kept = classify.screen(red, classify.hash_scorer(PRIMARY), ASYM).where("bucket <> 'dropped'").select("id").join(red, "id")
    n = classify.screen(kept, classify.hash_scorer(REFINE), REFINED).agg(F.count(F.lit(1)).alias("retained"), F.count_if(F.col("bucket") == "dropped").alias("dropped"))
    share = classify.ratio(F.col("dropped"), F.col("retained"))
    return n.select("retained", "dropped", share.alias("refinement_yield"), (share < F.lit(0.3)).alias("low_yield"))


@query(_SCORED + "SELECT l.quality, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (bucket = 'dropped') AS BIGINT) AS dropped FROM out JOIN labels l ON l.doc_id = out.ord GROUP BY l.quality")
def drop_safety_audit(spark, sf_dir):
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ord"), "quality")
    return _screened(spark, sf_dir).join(labels, "ord").groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("bucket") == "dropped").alias("dropped"))


def _other_sql(table, key, extra=""):
    return f"WITH s AS (SELECT {key} AS id, {_p(PRIMARY, key, 'coalesce(' + ('html' if table == 'pages' else 'text') + chr(44) + chr(39) * 2 + ')')} AS p FROM {table}) SELECT id, {_bucket(ASYM)} AS bucket, p AS probability FROM s"


@query(_other_sql("conversations", "conv_id::VARCHAR || ':' || turn::VARCHAR"))
def conversations_screen(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.lit(0).alias("ord"))
    return classify.screen(rows, classify.hash_scorer(PRIMARY), ASYM).select("id", "bucket", "probability")


@query(_other_sql("pages", "page_id::VARCHAR"))
def pages_screen(spark, sf_dir):
    rows = _table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), F.coalesce("html", F.lit("")).alias("text"), F.lit(0).alias("ord"))
    return classify.screen(rows, classify.hash_scorer(PRIMARY), ASYM).select("id", "bucket", "probability")


# -- the same screen by a Python function, and by a session over files


@query(_SCORED + "SELECT ord, id, bucket, probability, NULL::VARCHAR AS reason, NULL::VARCHAR AS message FROM out")
def screen_python_backend(spark, sf_dir):
    def call(question: str, text: str) -> float:
        import hashlib

        id_, _, body = text.partition("\x1f")
        return int(hashlib.md5(f"{PRIMARY}|{id_}|{body}".encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) / 4294967296.0

    items = _redacted(_items(spark, sf_dir)).select("ord", "id", F.concat("id", F.lit("\x1f"), "text").alias("text"))
    stage = contracts.Stage("q", contracts.YES, contracts.NO, ASYM)
    return backends.screened(items, backends.PythonBackend(call), stage, backends.Model("python", "md5"))


@query("SELECT user_id, min_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def first_per(spark, sf_dir):
    return classify.first_per(_table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id")


@query("SELECT doc_id AS id, CASE WHEN a < r AND b < a THEN 'both' WHEN a < r THEN 'adapter_bounds' WHEN b < a THEN 'token_budget' ELSE 'none' END AS reason FROM (SELECT doc_id, doc_id % 7 AS r, least(doc_id % 7, doc_id % 5) AS a, least(doc_id % 7, doc_id % 5, doc_id % 3) AS b FROM documents)")
def trim_reasons(spark, sf_dir):
    k = lambda n: F.col("doc_id") % n
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), evidence.trim_reason(k(7), F.least(k(7), k(5)), F.least(k(7), k(5), k(3))).alias("reason"))


@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, CASE event_type WHEN 'purchase' THEN 'CONFIRM' WHEN 'error' THEN 'INSUFFICIENT_EVIDENCE' ELSE 'REJECT' END AS disposition, count(*) AS n FROM events GROUP BY ALL")
def windowed_dispositions(spark, sf_dir):
    from siftwell.streaming import reviews

    return reviews.windowed_dispositions(_decisions(spark, sf_dir)).select(F.col("window.start").cast("date").alias("day"), "disposition", "n")


# -- the score cache: the second snapshot differs where doc_id % 10 = 0

_SECOND = "SELECT doc_id, doc_id::VARCHAR AS id, CASE WHEN doc_id % 10 = 0 THEN coalesce(text, '') || ' edited' ELSE coalesce(text, '') END AS text FROM documents"


def _snapshots(spark, sf_dir):
    first = _items(spark, sf_dir)
    return first, first.withColumn("text", F.when(F.col("ord") % 10 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text")))


def _cache_of(items, contract=PRIMARY):
    scored = items.withColumn("probability", classify.hash_probability(contract, F.col("id"), F.col("text")))
    return classify.fingerprints(scored, contract).select("contract_fp", "candidate_fp", classify.bucket_of(F.col("probability"), ASYM).alias("bucket"), "probability", F.col("ord").cast("long").alias("last_access"))


@query(f"WITH b AS ({_SECOND}) SELECT doc_id AS ord, id, {_bucket(ASYM, _p(PRIMARY))} AS bucket, {_p(PRIMARY)} AS probability, NULL::VARCHAR AS reason, doc_id % 10 <> 0 AS hit FROM b")
def cache_hits_misses(spark, sf_dir):
    first, second = _snapshots(spark, sf_dir)
    return classify.screen_cached(second, PRIMARY, _cache_of(first), classify.hash_scorer(PRIMARY), ASYM)


@query("SELECT CAST(0 AS BIGINT) AS hits, count(*) AS misses FROM documents")
def cache_contract_invalidation(spark, sf_dir):
    first, _ = _snapshots(spark, sf_dir)
    split = classify.cache_split(classify.fingerprints(first, REFINE), _cache_of(first))
    return split.agg(F.count_if(F.col("cached_bucket").isNotNull()).alias("hits"), F.count_if(F.col("cached_bucket").isNull()).alias("misses"))


@query("SELECT doc_id AS last_access FROM documents ORDER BY doc_id DESC LIMIT 100")
def cache_lru(spark, sf_dir):
    first, _ = _snapshots(spark, sf_dir)
    cache = _cache_of(first)
    return classify.cache_write(cache, cache, 100).select("last_access")


# -- discovery over the table read as files

FIND = Source(("docs/**/*.en", "docs/*/*.fr"), ("docs/src1/**",), (".git", "src2"), (Pattern("find-1", "License", "License", literal=True),))
MATCH = Source(("docs/**",), (), (), (Pattern("match-1", "credential", r"\b(?:token|secret|password)\s*[:=]", "i"),))
MULTI = Source(("docs/**",), (), (), (*FIND.patterns, *MATCH.patterns, Pattern("match-2", "line", r"[A-Z]{2,}!!")))
_V = "v AS (SELECT doc_id, 'docs/' || source || '/' || lpad(doc_id::VARCHAR, greatest(6, length(doc_id::VARCHAR))::INTEGER, '0') || '.' || lang AS source, coalesce(text, '') AS text FROM documents)"


def _files(spark, sf_dir):
    return tree.table_as_files(_table(spark, sf_dir, "documents")).withColumn("text", F.coalesce("text", F.lit("")))


_GLOBS = "((regexp_matches(source, '^docs/(?:.*/)?[^/]*\\.en$') OR regexp_matches(source, '^docs/[^/]*/[^/]*\\.fr$')) AND NOT regexp_matches(source, '^docs/src1/.*$'))"


@query(f"WITH {_V} SELECT doc_id, source FROM v WHERE {_GLOBS}")
def glob_include_exclude(spark, sf_dir):
    return _files(spark, sf_dir).where(discovery.included(F.col("source"), FIND.include, FIND.exclude)).select("doc_id", "source")


@query(f"WITH {_V} SELECT doc_id, source FROM v WHERE NOT list_has_any(string_split(source, '/')[1:-2], ['src2', 'src5'])")
def skip_dirs(spark, sf_dir):
    return _files(spark, sf_dir).where(discovery.included(F.col("source"), ("**",), (), ("src2", "src5"))).select("doc_id", "source")


def _wide_sql(text: str) -> str:
    """The UTF-16 code units of a text: its characters, and one more for each beyond the basic plane."""
    return f"(length({text}) + len(regexp_extract_all({text}, '[\\x{{10000}}-\\x{{10FFFF}}]')))"


def _matches_sql(where: str, pattern_id: str, regex: str) -> str:
    """(source, pattern_id, off, match_text, line, column) by prefix sums of gaps and matches."""
    return f"""SELECT source, '{pattern_id}' AS pattern_id, CAST({_wide_sql('left(text, off)')} AS INTEGER) AS off, match_text,
CAST(length(left(text, off)) - length(replace(left(text, off), chr(10), '')) + 1 AS INTEGER) AS line, CAST({_wide_sql('list_last(string_split(left(text, off), chr(10)))')} + 1 AS INTEGER) AS "column" FROM (
SELECT source, text, m[i] AS match_text, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS off FROM (
SELECT source, text, m, g, unnest(generate_series(1, len(m))) AS i FROM (
SELECT source, text, regexp_extract_all(text, '{regex}') AS m, string_split_regex(text, '{regex}') AS g FROM v WHERE {where} AND regexp_matches(text, '{regex}'))))"""


_R1, _R2, _R3 = "License", r"(?i)\b(?:token|secret|password)\s*[:=]", "[A-Z]{2,}!!"


def _places(found):
    return found.select("source", "pattern_id", "off", "match_text", "line", "column")


@query(f"WITH {_V} " + _matches_sql(_GLOBS + " AND NOT list_has_any(string_split(source, '/')[1:-2], ['.git', 'src2'])", "find-1", _R1))
def discover_literal(spark, sf_dir):
    files = _files(spark, sf_dir)
    return _places(discovery.located(files.where(discovery.included(F.col("source"), FIND.include, FIND.exclude, FIND.skip_dirs)), FIND.patterns))


@query(f"WITH {_V} " + _matches_sql("true", "match-1", _R2))
def discover_regex(spark, sf_dir):
    return _places(discovery.located(_files(spark, sf_dir), MATCH.patterns))


_MULTI_SQL = f"WITH {_V}, found AS (" + " UNION ALL ".join([_matches_sql("true", "find-1", _R1), _matches_sql("true", "match-1", _R2), _matches_sql("true", "match-2", _R3)]) + ") "


@query(_MULTI_SQL + "SELECT * FROM found")
def discover_multi_pattern(spark, sf_dir):
    return _places(discovery.located(_files(spark, sf_dir), MULTI.patterns))


@query(_MULTI_SQL + "SELECT pattern_id, count(*) AS n FROM found GROUP BY pattern_id")
def discover_count(spark, sf_dir):
    return discovery.counts(_files(spark, sf_dir), MULTI.patterns)


@query("SELECT page_id, len(regexp_extract_all(html, '(?i)<script')) AS n FROM pages WHERE regexp_matches(html, '(?i)<script')")
def discover_pages(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", F.col("page_id").cast("string").alias("source"), F.col("html").alias("text"))
    found = discovery.matches(pages.select("source", "text"), Pattern("m", "script", "<script", "i"))
    return found.groupBy(F.col("source").cast("long").alias("page_id")).agg(F.count(F.lit(1)).alias("n"))


AHEAD, RUNS = Pattern("match-3", "ahead", "(?=License)"), Pattern("match-4", "runs", "!*")


@query(f"WITH {_V}, found AS ({_matches_sql('true', 'match-3', _R1)}) SELECT source, pattern_id, off, '' AS match_text, line, \"column\" FROM found")
def discover_zero_width(spark, sf_dir):
    return _places(discovery.located(_files(spark, sf_dir), (AHEAD,)))


@query(f"WITH {_V} SELECT 'match-4' AS pattern_id, CAST(sum(length(replace(text, '!', '')) + 1 + len(regexp_extract_all(text, '!+'))) AS BIGINT) AS n FROM v")
def discover_zero_width_count(spark, sf_dir):
    return discovery.counts(_files(spark, sf_dir), (RUNS,))


def _units_sql(text: str) -> str:
    """The UTF-16 code units of a text as a list."""
    return f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 65536 THEN [unicode(c)::UBIGINT] ELSE [(55296 + (unicode(c) - 65536) // 1024)::UBIGINT, (56320 + (unicode(c) - 65536) % 1024)::UBIGINT] END))"


def _hash_sql(text: str) -> str:
    lane = lambda seed, factor: f"lpad(lower(to_hex(list_reduce(list_prepend({seed}::UBIGINT, {_units_sql(text)}), lambda a, c: (xor(a, c)::HUGEINT * {factor} % 4294967296)::UBIGINT))), 8, '0')"
    return f"left({lane(0x811C9DC5, 0x01000193)} || {lane(0x9E3779B9, 0x85EBCA6B)}, 12)"


@query(f"WITH {_V}, found AS ({_matches_sql('true', 'match-1', _R2)}) SELECT 'gs:match-1:' || source || ':' || line || ':' || \"column\" || ':' || {_hash_sql("'match-1' || chr(0) || match_text")} AS id, source, line, \"column\" FROM found")
def candidate_id_hash(spark, sf_dir):
    return discovery.candidates(_files(spark, sf_dir), MATCH).select("id", "source", "line", "column")


def _window_sql(window: contracts.Window, line: str = "line") -> str:
    shown = f"array_to_string(list_transform(generate_series(greatest(1, {line} - {window.before}), least(len(lines), {line} + {window.after})), lambda i: CASE WHEN i = {line} THEN '>' ELSE ' ' END || lpad(i::VARCHAR, greatest(5, length(i::VARCHAR))::INTEGER, ' ') || ' | ' || lines[i]), chr(10))"
    return f"CASE WHEN length({shown}) <= {window.chars} THEN {shown} ELSE left({shown}, {window.chars - 24}) || chr(10) || '[window truncated]' END"


_MATCH_SQL = f"WITH {_V}, found AS ({_matches_sql('true', 'match-1', _R2)}), f AS (SELECT found.*, string_split_regex(v.text, '\\r?\\n') AS lines FROM found JOIN v USING (source)) "


@query(_MATCH_SQL + f"SELECT source, off, md5({_window_sql(MATCH.snippet)}) AS window_md5 FROM f")
def candidate_window(spark, sf_dir):
    found = discovery.located(_files(spark, sf_dir), MATCH.patterns, {"shown": MATCH.snippet})
    return found.select("source", "off", F.md5(F.col("shown").cast("binary")).alias("window_md5"))


def _evidence_sql(detail: str, window: contracts.Window) -> str:
    return _MATCH_SQL + f"""SELECT source, off, md5(array_to_string(['provider=generic-source', 'detail={detail}', 'pattern=credential', 'location=' || source || ':' || line || ':' || "column", 'matched=' || to_json(match_text)::VARCHAR, {_window_sql(window)}], chr(10))) AS evidence_md5 FROM f"""


def _evidence(spark, sf_dir, detail):
    found = discovery.candidates(_files(spark, sf_dir), MATCH, windows={"_window": evidence.window_of(MATCH, detail)})
    return evidence.bodies(found, detail).select("source", "off", F.md5(F.col("evidence").cast("binary")).alias("evidence_md5"))


@query(_evidence_sql("standard", MATCH.standard))
def evidence_standard(spark, sf_dir):
    return _evidence(spark, sf_dir, "standard")


@query(_evidence_sql("expanded", MATCH.expanded))
def evidence_expanded(spark, sf_dir):
    return _evidence(spark, sf_dir, "expanded")


# -- providers and sessions over the table read as files

AUDIT = contracts.Preset("audit", "audit", "", "generic-source", Source(("docs/**",), (), (), MATCH.patterns, MATCH.snippet, MATCH.standard, MATCH.expanded, contracts.Limits(100_000, 20_000_000, 1_000_000)), contracts.Stage("is this a credential?", contracts.YES, contracts.NO, ASYM), contracts.Stage("does it leave the file?", contracts.YES, contracts.NO, REFINED))
_CANDIDATE_ID = "'gs:match-1:' || source || ':' || line || ':' || \"column\" || ':' || " + _hash_sql("'match-1' || chr(0) || match_text")
_CANDIDATES = f"{_MATCH_SQL}, c AS (SELECT {_CANDIDATE_ID} AS id, source, off, line, \"column\" AS col, match_text, lines, array_to_string(['source=' || source, 'pattern=credential', 'location=' || line || ':' || \"column\", {_window_sql(MATCH.snippet)}], chr(10)) AS text FROM f)"
_CANDIDATES_RED = f"{_CANDIDATES}, {_redaction_ctes('SELECT id AS key, text FROM c')}"


def _stage_p(stage: contracts.Stage, key: str = "key") -> str:
    return _p(classify.contract_of(stage).replace("'", "''"), key)


@query(f"{_CANDIDATES} SELECT id, CAST(row_number() OVER (ORDER BY source, off, id) - 1 AS BIGINT) AS ord, md5(text) AS text_md5 FROM c")
def candidate_order(spark, sf_dir):
    found = providers.GenericProvider(AUDIT.source).discover(spark, _files(spark, sf_dir).select("source", "text"))
    return found.select("id", F.col("ord").cast("long").alias("ord"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


_AUDITED = f"{_CANDIDATES_RED}, audited AS (SELECT key AS id, {_stage_p(AUDIT.primary)} AS p, n FROM red), o AS (SELECT id, {_bucket(ASYM)} AS bucket, p, n FROM audited)"


def _session(spark, sf_dir):
    from siftwell.plans.session import Session

    s = Session(spark)
    return s, s.primary(AUDIT, _files(spark, sf_dir).select("source", "text"), confirm=True, defer_review=True)


@query(
    f"""{_AUDITED} SELECT o.id, CASE bucket WHEN 'kept' THEN 'KEEP' WHEN 'dropped' THEN 'DROP' ELSE 'UNDECIDED' END AS label, CASE bucket WHEN 'kept' THEN p WHEN 'dropped' THEN 1::DOUBLE - p END AS confidence,
CASE bucket WHEN 'kept' THEN printf('keepProbability %.6f >= keep threshold {ASYM.keep:.6f}', p) WHEN 'dropped' THEN printf('keepProbability %.6f <= drop threshold {ASYM.drop:.6f}', p) ELSE printf('keepProbability %.6f is between drop threshold {ASYM.drop:.6f} and keep threshold {ASYM.keep:.6f}', p) END AS reason,
c.source, c.line, c.col AS "column" FROM o JOIN c USING (id)"""
)
def session_manifest(spark, sf_dir):
    s, run = _session(spark, sf_dir)
    found = s.runs[run]
    return classify.manifest(found.outcomes, ASYM, candidates=found.candidates).drop("ord")


@query(f"{_AUDITED} SELECT count(*) AS total, CAST(count(*) FILTER (bucket = 'kept') AS BIGINT) AS kept, CAST(count(*) FILTER (bucket = 'dropped') AS BIGINT) AS dropped, CAST(count(*) FILTER (n > 0) AS BIGINT) AS redaction_items, CAST(coalesce(sum(n), 0) AS BIGINT) AS redaction_count, count(*) AS evaluated, 'ok' AS status FROM o")
def session_summary(spark, sf_dir):
    s, run = _session(spark, sf_dir)
    n = s.summary(s.runs[run].primary) | {"evaluated": s.runs[run].primary.evaluated}
    names = ("total", "kept", "dropped", "redaction_items", "redaction_count", "evaluated", "status")
    return spark.createDataFrame([tuple(n[x] for x in names)], ", ".join(f"{x} {'string' if x == 'status' else 'long'}" for x in names))


@query(f"{_AUDITED}, again AS (SELECT {_bucket(REFINED, _stage_p(AUDIT.refinement, 'red.key').replace(', text)', ', red.text)'))} AS b FROM red JOIN o ON o.id = red.key WHERE o.bucket <> 'dropped'), m AS (SELECT count(*) AS retained, CAST(count(*) FILTER (b = 'dropped') AS BIGINT) AS dropped FROM again) SELECT retained, dropped, CASE WHEN retained > 0 THEN dropped / retained::DOUBLE ELSE 0 END AS yield, CASE WHEN retained > 0 THEN dropped / retained::DOUBLE ELSE 0 END < 0.3::DOUBLE AS low_yield FROM m")
def session_refinement(spark, sf_dir):
    s, run = _session(spark, sf_dir)
    n = s.refine(run, confirm=True)
    return spark.createDataFrame([(n["retained"], n["dropped"], n["yield"], n["low_yield"])], "retained long, dropped long, yield double, low_yield boolean")


@query(f"{_AUDITED}, t AS (SELECT id, row_number() OVER (ORDER BY CASE bucket WHEN 'kept' THEN 0 ELSE 1 END, source, off, id) AS n FROM o JOIN c USING (id) WHERE bucket <> 'dropped') SELECT id, CAST(n - 1 AS BIGINT) AS ord FROM t")
def session_review_targets(spark, sf_dir):
    s, run = _session(spark, sf_dir)
    return s.reviews[s.review_start(run)].targets.select(F.col("target").alias("id"), "ord")


BOUNDS = contracts.Budget(10, 30, 5, 60_000, 20_000)


@query(
    f"""{_CANDIDATES}, a AS (SELECT *, array_to_string(['provider=generic-source', 'detail=expanded', 'pattern=credential', 'location=' || source || ':' || line || ':' || col, 'matched=' || to_json(match_text)::VARCHAR, {_window_sql(MATCH.expanded)}], chr(10)) AS evidence FROM c ORDER BY source DESC, off DESC, id DESC LIMIT 60),
b AS (SELECT *, row_number() OVER w AS k, sum(length(evidence)) OVER w AS chars, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY off DESC, id DESC) = 1 THEN 1 ELSE 0 END AS new FROM a WINDOW w AS (ORDER BY source DESC, off DESC, id DESC)),
d AS (SELECT *, sum(new) OVER (ORDER BY k) AS sources FROM b) SELECT id, source, md5(evidence) AS evidence_md5, CAST(k - 1 AS INTEGER) AS ord FROM d WHERE k <= 30 AND chars <= 60000 AND sources <= 5"""
)
def evidence_by_ids(spark, sf_dir):
    """Sixty ids are asked for, a request's most; the provider's bounds cut them."""
    provider, files = providers.GenericProvider(AUDIT.source), _files(spark, sf_dir).select("source", "text")
    ids = [r["id"] for r in provider.discover(spark, files).orderBy(F.desc("ord")).select("id").limit(60).collect()]
    if not ids:
        return spark.createDataFrame([], "id string, source string, evidence_md5 string, ord int")
    return provider.evidence(spark, files, ids, BOUNDS, "expanded").select("id", "source", F.md5(F.col("evidence").cast("binary")).alias("evidence_md5"), "ord")


# -- packets: each source's documents are one request

PACK = contracts.Budget(max_items=20, max_sources=2, max_chars=20_000, max_tokens=3000, target_items=20)
_PACK_IN = "i AS (SELECT source AS packet, doc_id AS ord, doc_id::VARCHAR AS id, lang AS source, coalesce(text, '') AS evidence FROM documents), j AS (SELECT *, row_number() OVER (PARTITION BY packet ORDER BY ord) AS n, CASE WHEN row_number() OVER (PARTITION BY packet, source ORDER BY ord) = 1 THEN 1 ELSE 0 END AS new FROM i), k AS (SELECT *, sum(new) OVER w AS s, sum(length(evidence)) OVER w AS c, sum(length(to_json({'id': id, 'source': source, 'evidence': evidence})::VARCHAR) + 1) OVER w AS t FROM j WINDOW w AS (PARTITION BY packet ORDER BY ord ROWS UNBOUNDED PRECEDING))"


def _pack_in(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select(F.col("source").alias("packet"), F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("source"), F.coalesce("text", F.lit("")).alias("evidence"))


@query(f"WITH {_PACK_IN} SELECT packet, id FROM k WHERE n <= 20 AND s <= 2 AND c <= 20000")
def evidence_packing(spark, sf_dir):
    return evidence.packed(_pack_in(spark, sf_dir), PACK, "packet").select("packet", "id")


@query(f"WITH {_PACK_IN} SELECT packet, count(*) AS items, count(DISTINCT source) AS source_count, CAST(sum(length(evidence)) AS BIGINT) AS chars FROM k WHERE n <= 20 AND s <= 2 AND c <= 20000 AND t <= 11936 GROUP BY packet")
def token_budget(spark, sf_dir):
    return evidence.packet_stats(evidence.token_bounded(_pack_in(spark, sf_dir), PACK, "packet"), "packet")


CLIPPED = contracts.Budget(max_items=20, max_sources=2, max_chars=1000, target_items=20)


@query("WITH i AS (SELECT source AS packet, doc_id AS ord, doc_id::VARCHAR AS id, lang AS source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, coalesce(text, '') AS text FROM documents), j AS (SELECT packet, ord, id, n, CASE WHEN n = 1 THEN left(text, 1000) ELSE text END AS evidence, CASE WHEN row_number() OVER (PARTITION BY packet, source ORDER BY ord) = 1 THEN 1 ELSE 0 END AS new FROM i), k AS (SELECT *, sum(new) OVER w AS s, sum(length(evidence)) OVER w AS c FROM j WINDOW w AS (PARTITION BY packet ORDER BY ord ROWS UNBOUNDED PRECEDING)) SELECT packet, id, length(evidence) AS chars FROM k WHERE n <= 20 AND s <= 2 AND c <= 1000")
def evidence_packing_clipped(spark, sf_dir):
    return evidence.packed(_pack_in(spark, sf_dir), CLIPPED, "packet", clip_first=True).select("packet", "id", F.length("evidence").cast("long").alias("chars"))


# -- review: events as decisions of users

_DECIDE = "d AS (SELECT user_id AS target, CASE event_type WHEN 'purchase' THEN 'CONFIRM' WHEN 'error' THEN 'INSUFFICIENT_EVIDENCE' ELSE 'REJECT' END AS disposition, ts, event_id AS seq FROM events)"
_USED = f"{_DECIDE}, k AS (SELECT *, row_number() OVER w AS k, lag(disposition) OVER w AS before FROM d WINDOW w AS (PARTITION BY target ORDER BY ts, seq)), used AS (SELECT target, CASE WHEN k = 1 THEN 'standard' ELSE 'expanded' END AS detail, disposition FROM k WHERE k = 1 OR (k = 2 AND before = 'INSUFFICIENT_EVIDENCE'))"
_STATE = f"{_USED}, per AS (SELECT target, max(disposition) FILTER (detail = 'standard') AS a, max(disposition) FILTER (detail = 'expanded') AS b FROM used GROUP BY target), state AS (SELECT target, CASE WHEN coalesce(b, a) <> 'INSUFFICIENT_EVIDENCE' THEN 'reviewed' WHEN b IS NULL THEN 'needs_expanded' ELSE 'blocked' END AS state, CASE WHEN coalesce(b, a) <> 'INSUFFICIENT_EVIDENCE' THEN coalesce(b, a) WHEN b IS NOT NULL THEN 'INSUFFICIENT_EVIDENCE' END AS final_disposition FROM per)"


def _decisions(spark, sf_dir):
    kind = F.when(F.col("event_type") == "purchase", "CONFIRM").when(F.col("event_type") == "error", review.MORE).otherwise("REJECT")
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("target"), kind.alias("disposition"), "ts", F.col("event_id").alias("seq"))


def _used(spark, sf_dir):
    return review.attempts(_decisions(spark, sf_dir), ["ts", "seq"])


def _state(spark, sf_dir):
    d = _decisions(spark, sf_dir)
    return review.states(d.select("target"), review.attempts(d, ["ts", "seq"]))


@query(f"WITH {_USED} SELECT target, detail, disposition FROM used")
def review_apply_delta(spark, sf_dir):
    return _used(spark, sf_dir)


@query(f"WITH {_STATE} SELECT target, state, final_disposition FROM state")
def review_states(spark, sf_dir):
    return _state(spark, sf_dir)


@query(
    f"""WITH {_STATE}, a AS (SELECT count(*) AS targets, CAST(count(*) FILTER (state = 'reviewed') AS BIGINT) AS reviewed, CAST(count(*) FILTER (state = 'blocked') AS BIGINT) AS blocked, CAST(count(*) FILTER (state = 'needs_expanded') AS BIGINT) AS needs_expanded,
CAST(count(*) FILTER (state <> 'reviewed') AS BIGINT) AS unreviewed, CAST(count(*) FILTER (state IN ('pending', 'needs_expanded')) AS BIGINT) AS reviewable_remaining, CAST(count(*) FILTER (state = 'reviewed' AND final_disposition = 'CONFIRM') AS BIGINT) AS findings FROM state),
b AS (SELECT CAST(count(*) FILTER (detail = 'standard') AS BIGINT) AS evidence_seen, CAST(count(*) FILTER (detail = 'expanded') AS BIGINT) AS expanded_attempted, CAST(count(*) FILTER (detail = 'expanded' AND disposition <> 'INSUFFICIENT_EVIDENCE') AS BIGINT) AS expanded_resolved FROM used)
SELECT *, expanded_attempted / targets::DOUBLE AS expansion_rate, CASE WHEN expanded_attempted > 0 THEN expanded_resolved / expanded_attempted::DOUBLE ELSE 0 END AS expanded_resolution_rate, reviewable_remaining > 0 AS resume_available FROM a, b"""
)
def review_progress(spark, sf_dir):
    return review.progress(_state(spark, sf_dir), _used(spark, sf_dir))


_CONTRACT = "c AS (SELECT unnest(['CONFIRM', 'REJECT', 'INSUFFICIENT_EVIDENCE']) AS disposition)"


@query(f"WITH {_USED}, {_CONTRACT} SELECT c.disposition, CAST(count(used.target) AS BIGINT) AS n FROM c LEFT JOIN used USING (disposition) GROUP BY c.disposition")
def disposition_counts(spark, sf_dir):
    return review.disposition_counts(review.contract_table(spark), _used(spark, sf_dir))


@query(f"WITH {_STATE}, {_CONTRACT} SELECT c.disposition, CAST(count(state.target) AS BIGINT) AS n FROM c LEFT JOIN state ON state.final_disposition = c.disposition GROUP BY c.disposition")
def final_disposition_counts(spark, sf_dir):
    return review.disposition_counts(review.contract_table(spark), _state(spark, sf_dir), "final_disposition")


@query(f"WITH {_STATE} SELECT target FROM state WHERE state = 'reviewed' AND final_disposition = 'CONFIRM'")
def findings(spark, sf_dir):
    return _state(spark, sf_dir).where("state = 'reviewed' AND final_disposition = 'CONFIRM'").select("target")


@query(f"WITH {_STATE} SELECT target FROM state WHERE state = 'blocked'")
def blocked(spark, sf_dir):
    return _state(spark, sf_dir).where("state = 'blocked'").select("target")


@query(f"WITH {_USED}, s AS (SELECT DISTINCT user_id AS target FROM events), p AS (SELECT target, CASE WHEN target % 3 = 0 THEN 'expanded' ELSE 'standard' END AS detail FROM s WHERE target % 2 = 0) SELECT target, detail, CAST((row_number() OVER (PARTITION BY detail ORDER BY target) - 1) // 7 AS BIGINT) AS packet FROM p")
def review_packets(spark, sf_dir):
    t = _table(spark, sf_dir, "events").select(F.col("user_id").alias("target")).distinct()
    state = t.select("target", F.when(F.col("target") % 2 != 0, "reviewed").when(F.col("target") % 3 == 0, "needs_expanded").otherwise("pending").alias("state"))
    return review.packets(state, 7)


@query(
    f"""WITH {_DECIDE}, p AS (SELECT DISTINCT target AS id FROM d WHERE target % 2 = 0), e AS (SELECT target AS id, CASE WHEN seq % 13 = 0 THEN 'MAYBE' ELSE disposition END AS disposition, CASE WHEN seq % 17 = 0 THEN '  ' ELSE 'because' END AS rationale FROM d WHERE target % 3 = 0), n AS (SELECT id, count(*) AS n FROM e GROUP BY id)
SELECT id, CASE WHEN n IS NULL THEN 'missing' WHEN in_p IS NULL THEN 'extra' ELSE 'repeated' END AS issue FROM (SELECT id, true AS in_p FROM p) FULL JOIN n USING (id) WHERE n IS NULL OR in_p IS NULL OR n > 1
UNION ALL SELECT id, 'unknown_disposition' FROM e WHERE disposition = 'MAYBE' UNION ALL SELECT id, 'blank_rationale' FROM e WHERE trim(rationale) = ''"""
)
def review_validation_issues(spark, sf_dir):
    d = _decisions(spark, sf_dir)
    packet = d.where("target % 2 = 0").select(F.col("target").alias("id")).distinct()
    given = d.where("target % 3 = 0").select(F.col("target").alias("id"), F.when(F.col("seq") % 13 == 0, "MAYBE").otherwise(F.col("disposition")).alias("disposition"), F.when(F.col("seq") % 17 == 0, "  ").otherwise("because").alias("rationale"))
    return review.coverage_issues(packet, given, review.contract_table(spark))


_TWO = "p AS (SELECT doc_id AS id, ['CONFIRM', 'REJECT', 'INSUFFICIENT_EVIDENCE'][CAST(doc_id % 3 AS INTEGER) + 1] AS p FROM documents WHERE doc_id % 5 <> 0), c AS (SELECT doc_id AS id, ['CONFIRM', 'REJECT', 'INSUFFICIENT_EVIDENCE'][CAST((doc_id // 2) % 3 AS INTEGER) + 1] AS c FROM documents WHERE doc_id % 7 <> 0), j AS (SELECT * FROM p FULL JOIN c USING (id))"


def _moves(name: str, value: str) -> str:
    a, b = f"coalesce(p = '{value}', false)", f"coalesce(c = '{value}', false)"
    gone = "lost" if name == "confirm" else "resolved"
    return f"CAST(count(*) FILTER (NOT {a} AND {b}) AS BIGINT) AS new_{name}, CAST(count(*) FILTER ({a} AND NOT {b}) AS BIGINT) AS {gone}_{name}, CAST(count(*) FILTER ({a} AND {b}) AS BIGINT) AS stable_{name}"


@query(f"WITH {_TWO}, n AS (SELECT count(p) AS previous_total, count(c) AS current_total, CAST(count(*) FILTER (p IS NOT NULL AND c IS NOT NULL) AS BIGINT) AS common, CAST(count(*) FILTER (p = c) AS BIGINT) AS stable, CAST(count(*) FILTER (p <> c) AS BIGINT) AS changed, {_moves('confirm', 'CONFIRM')}, {_moves('blocked', 'INSUFFICIENT_EVIDENCE')} FROM j) SELECT *, CASE WHEN common > 0 THEN stable / common::DOUBLE ELSE 0 END AS stability_rate FROM n")
def stability_summary(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    pick = lambda k: F.element_at(F.array(F.lit("CONFIRM"), F.lit("REJECT"), F.lit(review.MORE)), (k % 3 + 1).cast("int"))
    return review.stability(docs.where("id % 5 <> 0").withColumn("disposition", pick(F.col("id"))), docs.where("id % 7 <> 0").withColumn("disposition", pick(F.floor(F.col("id") / 2))))


@query(f"WITH {_STATE} SELECT target, state, final_disposition FROM state")
def review_fold_stream(spark, sf_dir):
    from siftwell.streaming import reviews

    base = tables.new_path(spark, "review")
    schema = _table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    kind = F.when(F.col("event_type") == "purchase", "CONFIRM").when(F.col("event_type") == "error", review.MORE).otherwise("REJECT")
    stream = events.select(F.col("user_id").alias("target"), kind.alias("disposition"), "ts", F.col("event_id").alias("seq"))
    reviews.follow(stream, f"{base}/log", f"{base}/state").awaitTermination()
    return reviews.fold(spark, f"{base}/log")


# -- Python handlers, over programs of our own

PROGRAMS = [
    ("pkg/a.py", "def load(path):\n    rows = None\n    try:\n        rows = read(path)\n    except OSError:\n        rows = []\n    return rows\n\n\ndef first(path):\n    found = load(path)\n    if found:\n        return found[0]\n    raise ValueError(path)\n"),
    ("pkg/b.py", "from pkg.a import load\n\n\ndef each(paths):\n    for p in paths:\n        try:\n            store(load(p))\n        except (KeyError, ValueError) as error:\n            log(error)\n            continue\n        done(p)\n\n\ntry:\n    import fast\nexcept ImportError:\n    fast = None\n"),
    ("pkg/c.py", "class Box:\n    def get(self, key):\n        try:\n            return self.items[key]\n        except KeyError:\n            if self.strict:\n                raise\n            return {}\n        except:\n            pass\n"),
]


def _facts(spark):
    return python_handlers.parsed(spark.createDataFrame(PROGRAMS, "source string, text string"))


@query()
def py_candidates(spark, sf_dir):
    return python_handlers.discover(_facts(spark))


@query()
def py_handlers(spark, sf_dir):
    return python_handlers.rows_of(_facts(spark), "handlers").select("path", "start", "stop", "scope", "caught", "transfer", "exits", "branches")


@query()
def py_evidence_standard(spark, sf_dir):
    return python_handlers.evidence(_facts(spark), "standard")


@query()
def py_evidence_expanded(spark, sf_dir):
    return python_handlers.evidence(_facts(spark), "expanded")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redact, score, bucket and account for all documents, by language."""
    items = _redacted(_items(spark, sf_dir))
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "lang")
    out = classify.screen(items.drop("n"), classify.hash_scorer(PRIMARY), ASYM)
    return out.join(docs, "ord").groupBy("lang").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("bucket") == b).alias(b) for b in classify.BUCKETS])
