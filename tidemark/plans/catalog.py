"""Named queries over the driver's tables, each with its DuckDB equivalent.

The tables stand in for the engine's own: documents with embeddings for chunks (repo = source),
documents for files and raw rows, events for jobs and latencies, labels for relevance.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalar, vector
from tidemark.functions.stemmer import stem
from tidemark.operators import chunk as chunking
from tidemark.operators import grep as text_search
from tidemark.operators import hybrid, ingest, metrics, registry, scrub
from tidemark.operators.index import SearchIndex
from tidemark.runtime import shared_dir, ship, table
from tidemark.sources import drive, issues

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: English words of middling frequency in the documents.
SEARCH = "the and thereha of"
SEARCH_WORDS = ["the", "of", "with"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- adapters ---------------------------------------------------------------------------------

_TYPE = "CASE {0} % 3 WHEN 0 THEN 'git_repo' WHEN 1 THEN 'jira_project' ELSE 'drive_folder' END"
_CHUNKS_SQL = f"""
chunks AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id, d.doc_id, d.source AS source_id, {_TYPE.format('d.doc_id')} AS source_type, d.source AS repo, d.lang, d.text AS content,
         'docs/' || d.doc_id || '.txt' AS path, 'docs/' || d.doc_id || '.txt > ' || d.lang AS context_breadcrumb, e.embedding
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id
)"""


def chunks(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    d, e = table(spark, sf_dir, "documents", spread), table(spark, sf_dir, "embeddings")
    path = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    rows = d.join(e, d["doc_id"] == e["vec_id"], "left")
    return rows.select(
        F.col("doc_id").cast("string").alias("id"), "doc_id", F.col("source").alias("source_id"), F.expr(_TYPE.format("doc_id")).alias("source_type"), F.col("source").alias("repo"), "lang", F.col("text").alias("content"),
        scalar.breadcrumb(path, F.col("lang")).alias("context_breadcrumb"), F.create_map(F.lit("path"), path).alias("metadata"), "embedding",
    )


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"])


def files(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    d = table(spark, sf_dir, "documents", spread)
    return d.select(F.col("source").alias("source_id"), F.col("source").alias("repo"), F.lit("HEAD").alias("ref"), F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sources: a third of each type, some inactive, some denied, some with a slug."""
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").cast("string").alias("id"), F.expr(_TYPE.format("s_suppkey")).alias("source_type"), F.col("s_name").alias("name"), F.concat(F.lit("id-"), F.col("s_suppkey").cast("string")).alias("identifier"),
        F.when(F.col("s_suppkey") % 7 == 0, "deny").otherwise("allow").alias("policy"), (F.col("s_suppkey") % 5 != 0).alias("active"),
        F.when(F.col("s_suppkey") % 2 == 0, F.create_map(F.lit("mirror_slug"), F.concat(F.lit("slug-"), F.col("s_suppkey").cast("string")))).otherwise(F.create_map().cast("map<string,string>")).alias("config"),
    )


_SOURCES_SQL = f"""
sources AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS id, {_TYPE.format('s_suppkey')} AS source_type, s_name AS name, CASE WHEN s_suppkey % 7 = 0 THEN 'deny' ELSE 'allow' END AS policy,
         s_suppkey % 5 <> 0 AS active, CASE WHEN s_suppkey % 2 = 0 THEN 'slug-' || s_suppkey END AS slug, s_suppkey FROM supplier
)"""

# ---- search -----------------------------------------------------------------------------------

_DIST = "list_cosine_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0))"


def _vector_sql(where: str = "TRUE", pool: int = 200) -> str:
    return f"""vec AS (
  SELECT id, row_number() OVER (ORDER BY {_DIST}, id) AS rank FROM chunks WHERE embedding IS NOT NULL AND {where} QUALIFY rank <= {pool}
)"""


def _text_sql(where: str = "TRUE", pool: int = 200) -> str:
    n = len(SEARCH_WORDS)
    terms = " + ".join(f"coalesce(list_sum(list_transform(range(1, 1 + least(256, len(list_filter(ws, lambda x: x = '{w}')))), lambda j: 0.1::DOUBLE / (j * j))), 0) / 1.64493406685" for w in SEARCH_WORDS)
    has = " AND ".join(f"list_contains(ws, '{w}')" for w in SEARCH_WORDS)
    return f"""toks AS (
  SELECT id, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') AS ws FROM chunks WHERE {where}
), fts AS (
  SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM (SELECT id, ({terms}) / {n}.0 AS score FROM toks WHERE {has}) QUALIFY rank <= {pool}
)"""


def _hybrid_sql(where: str = "TRUE", pool: int = 200, k: int = 20) -> str:
    return f"""WITH {_CHUNKS_SQL}, {_vector_sql(where, pool)}, {_text_sql(where, pool)}, fused AS (
  SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT * FROM vec UNION ALL SELECT * FROM fts) GROUP BY id
)
SELECT f.id, c.source_type, c.repo, c.lang, c.context_breadcrumb, c.path, round(f.score, 9) AS score
FROM fused f JOIN chunks c USING (id) ORDER BY round(f.score, 9) DESC, f.id LIMIT {k}"""


def _hybrid(spark: SparkSession, sf_dir: str, pool: int = hybrid.POOL, arrow: bool = False, **filters) -> DataFrame:
    hits = hybrid.hybrid_search(chunks(spark, sf_dir, spread=True), " ".join(SEARCH_WORDS), query_vector(spark, sf_dir), 20, pool, "simple", arrow, **filters)
    return hits.select("id", "source_type", "repo", "lang", "context_breadcrumb", F.col("metadata")["path"].alias("path"), F.round("score", 9).alias("score"))


@query(f"WITH {_CHUNKS_SQL}, {_vector_sql(pool=50)} SELECT id, rank FROM vec")
def vector_topk(spark, sf_dir):
    return hybrid.vector_leg(chunks(spark, sf_dir), query_vector(spark, sf_dir), 50)


@query(f"WITH {_CHUNKS_SQL}, {_vector_sql(pool=50)} SELECT id, rank FROM vec")
def vector_topk_arrow(spark, sf_dir):
    return hybrid.vector_leg(chunks(spark, sf_dir), query_vector(spark, sf_dir), 50, arrow=True)


@query(f"WITH {_CHUNKS_SQL}, {_text_sql(pool=100)} SELECT id, rank FROM fts")
def fts_topk(spark, sf_dir):
    return hybrid.text_leg(chunks(spark, sf_dir, spread=True), " ".join(SEARCH_WORDS), 100, "simple")


def _index(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """An index of all chunks in the shared folder, built for the query."""
    ship(spark)
    path = f"{shared_dir(spark)}/tidemark/index-{uuid.uuid4().hex}"
    return SearchIndex.build(chunks(spark, sf_dir, spread=True), path, "simple", buckets=16, spread=1)


@query(f"WITH {_CHUNKS_SQL}, {_text_sql(pool=100)} SELECT id, rank FROM fts")
def text_index_topk(spark, sf_dir):
    return _index(spark, sf_dir).text_leg(" ".join(SEARCH_WORDS), 100)


@query(f"WITH {_CHUNKS_SQL}, {_vector_sql(pool=50)} SELECT id, rank FROM vec")
def vector_index_topk(spark, sf_dir):
    """All cells read, so that the rows are the exact ones: every vector is in the index."""
    return _index(spark, sf_dir).vector_leg(query_vector(spark, sf_dir), 50, probed=1.0)


@query(_hybrid_sql("lang = 'en'"))
def hybrid_index(spark, sf_dir):
    hits = _index(spark, sf_dir).search(" ".join(SEARCH_WORDS), query_vector(spark, sf_dir), probed=1.0, lang="en")
    return hits.select("id", "source_type", "repo", "lang", "context_breadcrumb", F.col("metadata")["path"].alias("path"), F.round("score", 9).alias("score"))


@query(_hybrid_sql())
def hybrid_rrf(spark, sf_dir):
    return _hybrid(spark, sf_dir)


@query(_hybrid_sql("repo = 'src3'"))
def hybrid_filter_repo(spark, sf_dir):
    return _hybrid(spark, sf_dir, repo="src3")


@query(_hybrid_sql("lang = 'en'"))
def hybrid_filter_lang(spark, sf_dir):
    return _hybrid(spark, sf_dir, lang="en")


@query(_hybrid_sql("source_type = 'jira_project' AND source_id = 'src4'"))
def hybrid_filter_source(spark, sf_dir):
    return _hybrid(spark, sf_dir, source_type="jira_project", source_id="src4")


@query(_hybrid_sql("lang = 'de'", pool=5))
def hybrid_starved(spark, sf_dir):
    """A pool of 5: rows out of scope would starve it if the filter came later."""
    return _hybrid(spark, sf_dir, pool=5, lang="de")


#: What the words of the English query are inflected to: written out, so that the SQL holds no stemmer.
_ENDINGS = ["", "s", "es", "ed", "ing", "ly", "edly", "ingly", "ings", "ness", "ment", "ments", "able", "ation", "ations", "er", "ers", "al", "ally", "ful", "fully", "ity", "ize", "ive", "ous", "ously", "y", "ion", "ions", "ism", "ist", "ance", "ence", "ant", "ent", "ate"]


def _forms(lexeme: str) -> str:
    return ", ".join(f"'{lexeme}{e}'" for e in dict.fromkeys(_ENDINGS) if stem(lexeme + e) == lexeme)


def _english_sql() -> str:
    """thereha or ("thin erer" and not trash), ranked by how often the lexemes occur."""
    lexemes = ("thereha", "thin", "erer", "trash")
    kind = "CASE " + " ".join(f"WHEN w IN ({_forms(x)}) THEN '{x}'" for x in lexemes) + " END"
    series = "coalesce(list_sum(list_transform(range(1, 1 + least(256, {0})), lambda j: 0.1::DOUBLE / (j * j))), 0) / 1.64493406685"
    score = " + ".join(series.format(x) for x in lexemes)
    return f"""WITH {_CHUNKS_SQL}, {_vector_sql()}, toks AS (
  SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM (SELECT id, regexp_extract_all(lower(context_breadcrumb || ' ' || content), '[\\p{{L}}\\p{{N}}]+') AS ws FROM chunks)
), marked AS (
  SELECT DISTINCT id, least(p, 16383) AS p, {kind} AS x FROM toks WHERE {kind} IS NOT NULL
), phrases AS (
  SELECT DISTINCT a.id FROM marked a JOIN marked b ON b.id = a.id AND b.p = a.p + 1 WHERE a.x = 'thin' AND b.x = 'erer'
), counts AS (
  SELECT id, {", ".join(f"count(*) FILTER (WHERE x = '{x}') AS {x}" for x in lexemes)} FROM marked GROUP BY id
), fts AS (
  SELECT id, row_number() OVER (ORDER BY round(score, 12) DESC, id) AS rank FROM (SELECT id, ({score}) / {len(lexemes)} AS score FROM counts WHERE thereha > 0 OR (trash = 0 AND id IN (SELECT id FROM phrases))) QUALIFY rank <= 200
), fused AS (
  SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT * FROM vec UNION ALL SELECT * FROM fts) GROUP BY id
)
SELECT f.id, c.source_type, c.repo, c.lang, c.context_breadcrumb, c.path, round(f.score, 9) AS score
FROM fused f JOIN chunks c USING (id) ORDER BY round(f.score, 9) DESC, f.id LIMIT 20"""


@query(_english_sql())
def hybrid_english(spark, sf_dir):
    """Stems, stop words, and a web-style query with an alternative, a phrase and a negation."""
    ship(spark)
    hits = hybrid.hybrid_search(chunks(spark, sf_dir, spread=True), 'thereha or the "thin erer" -trash', query_vector(spark, sf_dir), 20)
    return hits.select("id", "source_type", "repo", "lang", "context_breadcrumb", F.col("metadata")["path"].alias("path"), F.round("score", 9).alias("score"))


_AXIS = [1.0] + [0.0] * 63


@query("SELECT vec_id, round(list_cosine_distance(CAST(embedding AS DOUBLE[]), CAST([1.0] || list_transform(range(63), lambda x: 0.0) AS DOUBLE[])), 9) AS distance FROM embeddings")
def cosine_distances(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(vector.cosine_distance(F.col("embedding"), F.array(*(F.lit(x) for x in _AXIS))), 9).alias("distance"))


@query("""
SELECT vec_id, list_transform(list_slice(embedding, 1, 32), lambda x: round(CAST(x AS DOUBLE) / greatest(n, 1e-12), 9)) AS v
FROM (SELECT vec_id, embedding, sqrt(list_sum(list_transform(list_slice(embedding, 1, 32), lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings)""")
def matryoshka_norm(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.transform(vector.matryoshka(F.col("embedding"), 32), lambda x: F.round(x, 9)).alias("v"))


@query("""
SELECT doc_id, list_transform(v, lambda x: round(x / n, 6) + 0.0::DOUBLE) AS embedding FROM (
  SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (
    SELECT doc_id, list_transform(range(1, 385), lambda i: sin(h * (2 * i + 1) % 134217728 / 1e6)) AS v FROM (SELECT doc_id, CAST('0x' || substr(md5(text), 1, 12) AS BIGINT) AS h FROM documents)))""")
def stub_embeddings(spark, sf_dir):
    unit = vector.stub_embedding(F.col("text"), 384)
    return table(spark, sf_dir, "documents", spread=True).select("doc_id", F.transform(unit, lambda x: F.round(x, 6) + 0.0).alias("embedding"))


# ---- registry ---------------------------------------------------------------------------------


@query(f"WITH {_SOURCES_SQL} SELECT CASE WHEN source_type = 'git_repo' THEN coalesce(slug, name) ELSE name END AS repo, source_type FROM sources WHERE active AND policy = 'allow' ORDER BY source_type, name")
def list_repos(spark, sf_dir):
    return registry.list_repos(sources(spark, sf_dir))


@query(f"WITH {_SOURCES_SQL} SELECT id, coalesce(slug, name) AS repo FROM sources WHERE active AND policy = 'allow' AND source_type = 'git_repo'")
def git_repo_slugs(spark, sf_dir):
    return registry.resolve(sources(spark, sf_dir), None)


@query(f"""WITH {_SOURCES_SQL}, c AS (SELECT CAST(l_suppkey AS VARCHAR) AS id, count(*) AS n FROM lineitem GROUP BY 1), p AS (SELECT CAST(o_custkey AS VARCHAR) AS id, count(*) AS n FROM orders GROUP BY 1)
SELECT s.id, source_type, name, coalesce(c.n, 0) AS chunks, coalesce(p.n, 0) AS pending FROM sources s LEFT JOIN c USING (id) LEFT JOIN p USING (id) ORDER BY source_type, name""")
def source_status(spark, sf_dir):
    """Line items stand for chunks and orders for what is pending."""
    held = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("source_id"))
    pending = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("source_id"))
    return registry.source_status(sources(spark, sf_dir), held, pending)


_STATE = "CASE event_id % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'executing' WHEN 2 THEN 'discarded' ELSE 'retryable' END"


@query(f"""WITH {_SOURCES_SQL}, last AS (SELECT CAST(user_id AS VARCHAR) AS id, max(CAST(ts AS TIMESTAMP)) AS t FROM events GROUP BY 1)
SELECT id AS source_id, source_type FROM sources LEFT JOIN last USING (id)
WHERE active AND policy = 'allow' AND (t IS NULL OR t + to_minutes(CASE source_type WHEN 'git_repo' THEN 15 WHEN 'jira_project' THEN 60 ELSE 30 END) <= (SELECT max(t) FROM last))""")
def due_sources(spark, sf_dir):
    """Suppliers as sources and users' events as their syncs; now is the last event."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("source_id"), F.col("ts").cast("timestamp").alias("last_synced_at"))
    last = e.groupBy("source_id").agg(F.max("last_synced_at").alias("last_synced_at"))
    now = last.agg(F.max("last_synced_at").alias("now")).first()["now"]
    return registry.due(sources(spark, sf_dir), last, F.lit(now))


@query("""SELECT event_id AS id, CASE WHEN event_id % 11 = 0 THEN 'cancelled' WHEN event_id % 7 = 0 THEN 'scheduled' WHEN event_type <> 'error' THEN 'completed' WHEN event_id % 5 < 3 THEN 'retryable' ELSE 'discarded' END AS state,
CAST(CASE WHEN event_id % 11 <> 0 AND event_id % 7 = 0 THEN event_id % 5 ELSE event_id % 5 + 1 END AS BIGINT) AS attempt FROM events""")
def job_outcomes(spark, sf_dir):
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    attempts = e.select(
        i.alias("id"), (i % 5 + 1).alias("attempt"), F.lit(4).alias("max_attempts"), F.when(F.col("event_type") == "error", "failed").alias("error"),
        F.when(i % 7 == 0, F.lit(60)).alias("snooze_seconds"), F.when(i % 11 == 0, "content_too_large").alias("cancel_reason"),
    )
    return registry.outcomes(attempts).select("id", "state", F.col("attempt").cast("long").alias("attempt"))


@query(f"""WITH jobs AS (SELECT event_id AS id, {_STATE} AS state, CAST(ts AS TIMESTAMP) AS t FROM events), clock AS (SELECT max(t) AS now FROM jobs)
SELECT id, CASE WHEN state = 'executing' AND t < now - INTERVAL 20 MINUTE THEN 'available' ELSE state END AS state FROM jobs, clock WHERE NOT (state IN ('completed', 'discarded') AND t < now - INTERVAL 14 DAY)""")
def prune_jobs(spark, sf_dir):
    jobs = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.expr(_STATE).alias("state"), F.col("ts").cast("timestamp").alias("at"))
    now = jobs.agg(F.max("at").alias("now")).first()["now"]
    return registry.prune_jobs(jobs, F.lit(now)).select("id", "state")


@query("SELECT event_type AS state, count(*) AS jobs FROM events GROUP BY event_type")
def jobs_by_state(spark, sf_dir):
    return registry.jobs_by_state(table(spark, sf_dir, "events").withColumnRenamed("event_type", "state"))


@query(f"""WITH {_SOURCES_SQL}, n AS (SELECT id, source_type, CASE WHEN s_suppkey % 3 = 0 THEN name || '-new' ELSE name END AS name FROM sources WHERE s_suppkey % 4 <> 1),
o AS (SELECT id, source_type, name FROM sources WHERE s_suppkey % 4 <> 2)
SELECT coalesce(o.id, n.id) AS id, coalesce(o.source_type, n.source_type) AS source_type, coalesce(n.name, o.name) AS name FROM o FULL JOIN n ON o.id = n.id""")
def source_upsert(spark, sf_dir):
    s = sources(spark, sf_dir)
    n = F.col("id").cast("long")
    new = s.filter(n % 4 != 1).withColumn("name", F.when(n % 3 == 0, F.concat("name", F.lit("-new"))).otherwise(F.col("name")))
    return ingest.upsert_sources(s.filter(n % 4 != 2), new).select("id", "source_type", "name")


# ---- exact text -------------------------------------------------------------------------------


@query("""
WITH lines AS (
  SELECT source AS repo, 'docs/' || doc_id || '.txt' AS path, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS text, generate_subscripts(string_split(regexp_replace(text, '\\n$', ''), chr(10)), 1) AS line FROM documents
)
SELECT repo, path, CAST(line AS INTEGER) AS line, text FROM lines WHERE regexp_matches(text, 'tha[a-z]*ing')
QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY line) <= 100""")
def grep_lines(spark, sf_dir):
    return text_search.grep_lines(files(spark, sf_dir, spread=True), "tha[a-z]*ing")


@query("SELECT source AS repo, 'docs/' || doc_id || '.txt' AS path, 'HEAD' AS ref, text AS content, octet_length(encode(text)) > 5000000 AS too_large FROM documents WHERE source = 'src7' AND doc_id = 7")
def get_file(spark, sf_dir):
    return text_search.get_file(files(spark, sf_dir), "src7", "docs/7.txt")


@query(f"""WITH {_CHUNKS_SQL} SELECT DISTINCT id FROM chunks WHERE (repo = 'src3' AND starts_with(path, 'docs/1')) OR (contains(lower(context_breadcrumb), '> fr') AND starts_with(path, 'docs/2'))""")
def relevance_matchers(spark, sf_dir):
    return metrics.relevant(chunks(spark, sf_dir), [{"repo": "src3", "path_prefix": "docs/1"}, {"breadcrumb_substring": "> FR", "path_prefix": "docs/2"}])


# ---- scrubbing --------------------------------------------------------------------------------

# written out here and not taken from the engine, so that the comparison means something
_GENERIC = r"""(?i)(?:token|secret|passwd|password|api_key|api-key|apikey)[ \t\r\n\f]*[:=][ \t\r\n\f]*["'']?[^ \t\r\n\f"'']{8,}["'']?"""


def _raw(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents", spread=True)
    return d.select("doc_id", F.col("source").alias("source_id"), F.expr(_TYPE.format("doc_id")).alias("source_type"), F.concat(F.lit("repo:"), "source", F.lit(":"), F.col("doc_id").cast("string")).alias("natural_key"), F.col("text").alias("raw_content"))


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{_GENERIC}')) AS INTEGER) AS findings FROM documents WHERE regexp_matches(text, '{_GENERIC}')")
def secret_scan(spark, sf_dir):
    ship(spark)
    rows = scrub.scrub_rows(_raw(spark, sf_dir))
    return rows.filter(F.size("scrub.findings") > 0).select("doc_id", F.size("scrub.findings").alias("findings"))


@query(f"""SELECT doc_id, regexp_replace(text, '{_GENERIC}', '[REDACTED:generic_secret]', 'g') AS content, CASE WHEN regexp_matches(text, '{_GENERIC}') THEN 'redacted' ELSE 'clean' END AS secrets_status,
CASE WHEN doc_id % 3 = 0 THEN 'gitleaks_degraded_regex' ELSE 'regex' END AS scrub_mode FROM documents""")
def secret_redact(spark, sf_dir):
    ship(spark)
    rows = scrub.scrub_rows(_raw(spark, sf_dir))
    return rows.select("doc_id", F.col("scrub.redacted_content").alias("content"), "scrub.secrets_status", "scrub.scrub_mode")


@query(f"""SELECT 'repo:' || source || ':' || doc_id AS file_reference, 'generic-secret' AS rule_id, 'generic_secret' AS secret_type, sha256(m) AS match_hash, 'redacted' AS action
FROM (SELECT source, doc_id, unnest(regexp_extract_all(text, '{_GENERIC}')) AS m FROM documents)""")
def secret_audit(spark, sf_dir):
    ship(spark)
    return scrub.audit(scrub.scrub_rows(_raw(spark, sf_dir))).select("file_reference", "rule_id", "secret_type", "match_hash", "action")


# ---- chunking ---------------------------------------------------------------------------------


def _blocks_sql(source: str) -> str:
    """lines(doc_id, n, line) and blocks(doc_id, first, last) of the texts of a relation: a block ends
    with the line that makes it 6,000 bytes long, or, with no brace open, with a blank line or the one
    that makes it 1,500."""
    return f"""lines AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line FROM {source}
), sized AS (
  SELECT doc_id, n, octet_length(encode(line)) + 1 AS b, trim(line) = '' AS blank, len(replace(line, '}}', '')) - len(replace(line, '{{', '')) AS d FROM lines
), walk AS (
  SELECT doc_id, n, CASE WHEN blank THEN 0 ELSE n END AS first, CASE WHEN blank THEN 0 ELSE b END AS size, CASE WHEN blank THEN 0 ELSE greatest(d, 0) END AS depth,
    CASE WHEN NOT blank AND b >= 6000 THEN 1 ELSE 0 END AS closed FROM sized WHERE n = 1
  UNION ALL
  SELECT s.doc_id, s.n,
    CASE WHEN w.closed = 1 OR w.first = 0 THEN CASE WHEN s.blank THEN 0 ELSE s.n END ELSE w.first END,
    CASE WHEN w.closed = 1 OR w.first = 0 THEN CASE WHEN s.blank THEN 0 ELSE s.b END ELSE w.size + s.b END,
    CASE WHEN w.closed = 1 OR w.first = 0 THEN CASE WHEN s.blank THEN 0 ELSE greatest(s.d, 0) END ELSE greatest(w.depth + s.d, 0) END,
    CASE WHEN w.closed = 1 OR w.first = 0 THEN CASE WHEN NOT s.blank AND s.b >= 6000 THEN 1 ELSE 0 END
         ELSE CASE WHEN w.size + s.b >= 6000 OR (w.depth + s.d <= 0 AND (s.blank OR w.size + s.b >= 1500)) THEN 1 ELSE 0 END END
  FROM walk w JOIN sized s ON s.doc_id = w.doc_id AND s.n = w.n + 1
), blocks AS (
  SELECT w.doc_id, w.first, max(CASE WHEN NOT s.blank THEN w.n END) AS last FROM walk w JOIN sized s ON s.doc_id = w.doc_id AND s.n = w.n WHERE w.first > 0 GROUP BY w.doc_id, w.first
)"""


@query(f"WITH RECURSIVE {_blocks_sql('documents')} SELECT doc_id, CAST(first AS INTEGER) AS start_line, CAST(last AS INTEGER) AS end_line FROM blocks")
def chunk_heuristic(spark, sf_dir):
    ship(spark)
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.inline(chunking.heuristic_udf("text"))).select("doc_id", "start_line", "end_line")


@query("""SELECT doc_id, sha256('repo:' || source || ':docs/' || doc_id || '.txt|0|') AS chunk_key, sha256(text) AS content_hash, 'docs/' || doc_id || '.txt > ' || lang AS breadcrumb,
'docs/' || doc_id || '.txt > ' || lang || chr(10) || chr(10) || text AS embedded FROM documents""")
def chunk_keys(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    key = scalar.chunk_key(scalar.natural_key("repo", F.col("source"), path), F.lit(0), F.lit(None).cast("string"))
    crumb = scalar.breadcrumb(path, F.col("lang"))
    return d.select("doc_id", key.alias("chunk_key"), scalar.sha256(F.col("text")).alias("content_hash"), crumb.alias("breadcrumb"), scalar.with_breadcrumb(crumb, F.col("text")).alias("embedded"))


@query("SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dups(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy(scalar.sha256(F.col("text")).alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


@query(f"""WITH RECURSIVE scrubbed AS (
  SELECT doc_id, source, regexp_replace(text, '{_GENERIC}', '[REDACTED:generic_secret]', 'g') AS text, CASE WHEN regexp_matches(text, '{_GENERIC}') THEN 'redacted' ELSE 'clean' END AS secrets_status FROM documents
), {_blocks_sql('scrubbed')}, cut AS (
  SELECT b.doc_id, b.first, row_number() OVER (PARTITION BY b.doc_id ORDER BY b.first) - 1 AS i, string_agg(l.line, chr(10) ORDER BY l.n) AS text
  FROM blocks b JOIN lines l ON l.doc_id = b.doc_id AND l.n BETWEEN b.first AND b.last GROUP BY b.doc_id, b.first
), keyed AS (
  SELECT s.source AS source_id, sha256('repo:' || s.source || ':docs/' || s.doc_id || '.txt|' || c.i || '|') AS chunk_key, sha256(c.text) AS content_hash, 'docs/' || s.doc_id || '.txt' AS context_breadcrumb,
    'heuristic_fallback' AS parse_status, s.secrets_status FROM cut c JOIN scrubbed s USING (doc_id)
)
SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id, source_id, chunk_key, content_hash, context_breadcrumb, parse_status, secrets_status
FROM (SELECT *, sha256(source_id || '|' || chunk_key) AS h FROM keyed)""")
def chunk_pipeline(spark, sf_dir):
    """Files to chunk rows: keyed, scrubbed, chunked, embedded."""
    ship(spark)
    rows = ingest.chunk_table(ingest.raw_rows(files(spark, sf_dir, spread=True)), F.lit("2024-01-01").cast("timestamp"))
    return rows.select("id", "source_id", "chunk_key", "content_hash", "context_breadcrumb", "parse_status", "secrets_status")


# ---- incremental maintenance ------------------------------------------------------------------

_OLD, _NEW = "doc_id % 7 <> 0", "doc_id % 5 <> 0"
_NEW_HASH = "sha256(CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END)"


@query(f"""WITH o AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE {_OLD}), n AS (SELECT doc_id, {_NEW_HASH} AS h FROM documents WHERE {_NEW})
SELECT 'docs/' || coalesce(o.doc_id, n.doc_id) AS path, CASE WHEN n.doc_id IS NULL THEN 'deleted' ELSE 'modified' END AS status FROM o FULL JOIN n USING (doc_id) WHERE o.h IS DISTINCT FROM n.h""")
def changed_entries(spark, sf_dir):
    return ingest.changed_entries(*_snapshots(spark, sf_dir))


def _snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("path")
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return d.filter(_OLD).select(path, F.sha2("text", 256).alias("content_hash")), d.filter(_NEW).select(path, F.sha2(text, 256).alias("content_hash"))


@query("SELECT 'docs/' || doc_id AS path, 'added' AS status FROM documents")
def first_sync_entries(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return ingest.changed_entries(None, d.select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("path")))


@query(f"""WITH o AS (SELECT doc_id, source, lang, text FROM documents WHERE {_OLD}), n AS (SELECT doc_id, 'new-' || source AS source, CAST(NULL AS VARCHAR) AS lang, text || '!' AS text FROM documents WHERE {_NEW})
SELECT coalesce(o.doc_id, n.doc_id) AS chunk_key, CASE WHEN o.doc_id IS NOT NULL THEN o.source ELSE n.source END AS repo, CASE WHEN o.doc_id IS NOT NULL THEN o.lang ELSE n.lang END AS lang, CASE WHEN n.doc_id IS NOT NULL THEN n.text ELSE o.text END AS content
FROM o FULL JOIN n USING (doc_id)""")
def merge_upsert(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    old = d.filter(_OLD).select(F.col("doc_id").alias("chunk_key"), F.col("source").alias("repo"), "lang", F.col("text").alias("content"))
    new = d.filter(_NEW).select(F.col("doc_id").alias("chunk_key"), F.concat(F.lit("new-"), "source").alias("repo"), F.lit(None).cast("string").alias("lang"), F.concat("text", F.lit("!")).alias("content"))
    return ingest.merge(old, new, ["chunk_key"], ["content"])


@query(f"WITH {_CHUNKS_SQL} SELECT id, repo, path FROM chunks WHERE doc_id % 7 <> 0")
def prune_deleted(spark, sf_dir):
    c = chunks(spark, sf_dir)
    gone = c.filter("doc_id % 7 = 0").select("source_id", F.col("metadata")["path"].alias("path"))
    return ingest.prune(c, gone).select("id", "repo", F.col("metadata")["path"].alias("path"))


@query(f"""WITH {_SOURCES_SQL} SELECT CAST(l_suppkey AS VARCHAR) AS source_id, count(*) AS chunks FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY 1""")
def cascade_delete(spark, sf_dir):
    s = sources(spark, sf_dir)
    held = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("source_id"))
    states = s.select(F.col("id").alias("source_id"))
    _, left, _ = ingest.cascade(s, held, states, s.filter("source_type = 'git_repo'").select("id"))
    return left.groupBy("source_id").agg(F.count("*").alias("chunks"))


@query("""WITH m AS (SELECT CAST(user_id AS VARCHAR) AS source_id, max(CAST(ts AS VARCHAR)) AS v FROM events GROUP BY 1)
SELECT coalesce(CAST(c_custkey AS VARCHAR), source_id) AS source_id, coalesce(v, CASE WHEN c_custkey IS NOT NULL THEN 'none' END) AS watermark, CASE WHEN v IS NULL THEN 'error' ELSE 'idle' END AS status
FROM customer FULL JOIN m ON CAST(c_custkey AS VARCHAR) = source_id""")
def cursor_upsert(spark, sf_dir):
    states = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("source_id"), F.create_map(F.lit("watermark"), F.lit("none")).alias("cursor"), F.lit("error").alias("status"), F.lit(None).cast("timestamp").alias("last_synced_at"))
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("source_id"), F.col("ts").cast("timestamp_ntz").cast("string").alias("ts"))
    moved = events.groupBy("source_id").agg(F.max("ts").alias("value")).select("source_id", F.lit("watermark").alias("key"), "value", F.lit("2024-01-01").cast("timestamp").alias("at"))
    return ingest.advance_cursors(states, moved).select("source_id", F.col("cursor")["watermark"].alias("watermark"), "status")


@query("SELECT max(o_orderpriority) AS watermark FROM orders")
def cursor_max(spark, sf_dir):
    return ingest.watermark(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("SELECT user_id AS repo, arg_max(event_id, (ts, event_id)) AS sha FROM events GROUP BY user_id")
def resolve_heads(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return ingest.head(e.select(F.col("user_id").alias("repo"), F.col("event_id").alias("sha"), F.col("ts").alias("committed_at")))


@query("SELECT CAST(o_custkey AS VARCHAR) AS source_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS newest, count(*) AS n FROM orders GROUP BY 1")
def latest_per_key(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    last = ingest.latest(o.select(F.col("o_custkey").cast("string").alias("source_id"), "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("at"), F.lit(1).alias("one")), ["source_id"], F.col("at"))
    return last.select("source_id", F.col("o_orderkey").alias("newest")).join(o.groupBy(F.col("o_custkey").cast("string").alias("source_id")).agg(F.count("*").alias("n")), "source_id")


# ---- retrieval quality ------------------------------------------------------------------------


@query("""
WITH base AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT * FROM base WHERE vec_id % 50 = 0),
ranked AS (
  SELECT q.vec_id AS query, b.vec_id AS id, b.label = q.label AS hit, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_distance(b.v, q.v), 12), b.vec_id) AS rank FROM q, base b QUALIFY rank <= 10
), got AS (SELECT query, sum(CASE WHEN hit THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM ranked GROUP BY query),
ideal AS (SELECT q.vec_id AS query, list_sum(list_transform(range(1, 1 + least(10, count(*))), lambda i: 1 / log2(i + 1))) AS idcg FROM q JOIN base b ON b.label = q.label GROUP BY q.vec_id)
SELECT query, round(dcg / idcg, 9) AS ndcg FROM got JOIN ideal USING (query)""")
def ndcg_at_k(spark, sf_dir):
    """Every vector whose id 50 divides as a query over all vectors; relevant is what shares its label."""
    ship(spark)
    e = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    q = e.filter("id % 50 = 0")
    ranked = vector.nearest(e, q, 10)
    return metrics.ndcg_by_label(ranked, q.select(F.col("id").alias("query"), "label"), e.select("id", "label"), 10).select("query", F.round("ndcg", 9).alias("ndcg"))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type")
def percentiles(spark, sf_dir):
    return metrics.percentiles(table(spark, sf_dir, "events"), "event_type", "value", (50, 95, 99))


@query("""WITH s AS (SELECT c_custkey, list_filter([c_custkey % 11, c_custkey % 7, c_nationkey], lambda x: x % 2 = 0) AS a, list_filter([c_custkey % 5, c_nationkey], lambda x: x % 2 = 0) AS b FROM customer)
SELECT c_custkey, round(CASE WHEN greatest(len(list_distinct(a)), len(list_distinct(b))) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct(a), list_distinct(b))) / greatest(len(list_distinct(a)), len(list_distinct(b)))::DOUBLE END, 9) AS overlap FROM s""")
def overlap_at_k(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    even = lambda *x: F.filter(F.array(*x), lambda v: v % 2 == 0)
    key, nation = F.col("c_custkey"), F.col("c_nationkey").cast("long")
    return c.select("c_custkey", F.round(metrics.overlap(even(key % 11, key % 7, nation), even(key % 5, nation)), 9).alias("overlap"))


@query("""SELECT count(*) AS queries_total, count(*) FILTER (WHERE event_type <> 'error') AS queries_resolved, count(*) FILTER (WHERE event_type = 'error') AS queries_unresolved,
round(avg(value) FILTER (WHERE event_type <> 'error'), 6) AS mean_ndcg, quantile_disc(value, 0.5) FILTER (WHERE event_type <> 'error') AS p50, quantile_disc(value, 0.95) FILTER (WHERE event_type <> 'error') AS p95,
quantile_disc(value, 0.99) FILTER (WHERE event_type <> 'error') AS p99 FROM events""")
def bench_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("event_type") != "error").alias("resolvable"), F.col("value").alias("ndcg"), F.col("value").alias("latency_ms"))
    return metrics.summary(e).withColumn("mean_ndcg", F.round("mean_ndcg", 6))


# ---- scalar functions and parsers -------------------------------------------------------------


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'rust' WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE 'java' END AS lang,
CASE p_partkey % 4 WHEN 0 THEN 30 ELSE 60 END AS wait, CAST(len(p_name) - len(replace(p_name, 'a', '')) AS INTEGER) AS braces,
replace(replace(replace(p_name || '_%\\', '\\', '\\\\'), '%', '\\%'), '_', '\\_') AS escaped FROM part""")
def scalar_functions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    pick = lambda n, *x: F.element_at(F.array(*map(F.lit, x)), (F.col("p_partkey") % n + 1).cast("int"))
    return p.select(
        "p_partkey", scalar.language(pick(6, "a/b.py", "x.d.tsx", "lib.rs", "Makefile", ".py", "A.java")).alias("lang"), scalar.retry_after(pick(4, "30", "Wed, 21 Oct 2015 07:28:00 GMT", None, "0")).alias("wait"),
        scalar.brace_delta(F.replace("p_name", F.lit("a"), F.lit("{"))).alias("braces"), scalar.like_escape(F.concat("p_name", F.lit("_%\\"))).alias("escaped"),
    )


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'unsupported_language' WHEN 2 THEN 'binary' END AS reason, CASE p_partkey % 4 WHEN 0 THEN 'heuristic_fallback' WHEN 2 THEN 'skip' ELSE 'ok' END AS outcome, p_partkey % 4 = 2 AS is_binary FROM part""")
def binary_guard(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    n = F.col("p_partkey") % 4
    content = F.when(n == 2, F.concat("p_name", F.lit("\x00"))).otherwise(F.col("p_name"))
    reason = scalar.preflight(F.when(n == 0, "cobol").otherwise("python"), content)
    return p.select("p_partkey", reason.alias("reason"), scalar.fallback(reason, F.lit(True)).alias("outcome"), scalar.is_binary(content.cast("binary")).alias("is_binary"))


@query("""SELECT 'K-' || conv_id || '-' || turn AS key, role || chr(10) || chr(10) || text AS text, '2024-01-' || lpad(CAST(1 + turn % 28 AS VARCHAR), 2, '0') AS resolutiondate FROM conversations""")
def jira_parse(spark, sf_dir):
    """Turns of conversations as issues with rich-text descriptions."""
    ship(spark)
    c = table(spark, sf_dir, "conversations")
    leaf = F.array(F.struct(F.lit("text").alias("type"), F.col("text")))
    tree = F.struct(F.lit("doc").alias("type"), F.array(F.struct(F.lit("paragraph").alias("type"), leaf.alias("content"))).alias("content"))
    date = F.concat(F.lit("2024-01-"), F.lpad((1 + F.col("turn") % 28).cast("string"), 2, "0"))
    fields = F.struct(F.col("role").alias("summary"), tree.alias("description"), date.alias("resolutiondate"))
    issue = F.struct(F.concat(F.lit("K-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("key"), fields.alias("fields"))
    return issues.parse_issues(c.select(F.to_json(F.struct(F.array(issue).alias("issues"))).alias("body")))


@query("SELECT 'f' || page_id AS id, CASE WHEN page_id % 5 = 0 THEN 'removed' ELSE 'document' END AS kind FROM pages WHERE page_id % 5 = 0 OR page_id % 2 = 1")
def drive_parse(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    key = F.concat(F.lit("f"), F.col("page_id").cast("string"))
    kind = F.when(F.col("page_id") % 2 == 1, drive.DOCUMENT).otherwise("image/png")
    file = F.when(F.col("page_id") % 10 != 5, F.struct(key.alias("id"), F.col("url").alias("name"), kind.alias("mimeType")))
    change = F.struct(key.alias("fileId"), (F.col("page_id") % 5 == 0).alias("removed"), file.alias("file"))
    body = F.to_json(F.struct(key.alias("newStartPageToken"), F.array(change).alias("changes")))
    removed, docs, _ = drive.parse_changes(p.select(body.alias("body")))
    return removed.select("id", F.lit("removed").alias("kind")).unionByName(docs.select("id", F.lit("document").alias("kind")))


@query("SELECT repeat('word ', 14) || 'passage-' || i AS passage FROM range(1, 21) t(i)")
def synthetic_passages(spark, sf_dir):
    return spark.range(1, 21).select(F.concat(F.repeat(F.lit("word "), 14), F.lit("passage-"), F.col("id").cast("string")).alias("passage"))
