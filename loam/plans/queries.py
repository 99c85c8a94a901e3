"""Queries that bind the engine's operators to the test tables, and the SQL that says the same.

documents are memories (node = doc_id, session = source, text = all of it), labels give kind and state, conversations are
sessions, events are citations and runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators import audit, budgets, control, lexical, mining, retrieval, store, synthesis, vectors
from loam.session import LIMITS
from loam.streaming.ingest import windowed_counts

SPACE = r"[\s\x{FEFF}]"  # as RE2 has it, ASCII white space; the test tables hold no other


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _memories(spark: SparkSession, d: str) -> DataFrame:
    labels = _table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "preference").otherwise("fact").alias("kind"), F.when(F.col("toxic") == 1, "retired").otherwise("active").alias("state"))
    docs = _table(spark, d, "documents").select("doc_id", "text", "source")
    return docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("memory_id"), "text", "source", F.coalesce("kind", F.lit("fact")).alias("kind"), F.coalesce("state", F.lit("active")).alias("state"))


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return _memories(spark, d).select(F.col("memory_id").alias("version_id"), F.col("source").alias("session_id"), "kind", "text")


def _searches(spark: SparkSession, d: str) -> DataFrame:
    """The queries of text searches: every document whose id is divisible by 100, whole; its vector is that of the same id."""
    return _table(spark, d, "documents").filter(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), "text")


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


MEMORIES = """memories AS (SELECT d.doc_id AS memory_id, d.text, d.source, CASE WHEN l.quality = 1 THEN 'preference' ELSE 'fact' END AS kind,
    CASE WHEN l.toxic = 1 THEN 'retired' ELSE 'active' END AS state FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
NORMAL = "lower(regexp_replace(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'))"
TERMS = "[lower(t) FOR t IN regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}]+')]"
SEARCH_TERMS = "[lower(t) FOR t IN regexp_extract_all(strip_accents({0}), '[\\p{{L}}\\p{{N}}]+')]"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query(f"WITH {MEMORIES} SELECT memory_id, kind, text FROM memories WHERE state = 'active'")
def active_memories(spark, d):
    return _memories(spark, d).filter("state = 'active'").select("memory_id", "kind", "text")


@query(f"WITH {MEMORIES} SELECT memory_id, state, CASE WHEN state = 'active' THEN 'active' ELSE 'other' END AS section FROM memories WHERE contains(lower(text), 'apache') OR contains(lower('M:' || memory_id), 'apache')")
def list_substring(spark, d):
    return audit.matching(_memories(spark, d), "Apache").select("memory_id", "state", "section")


@query(f"WITH {MEMORIES} SELECT s.state, count(m.memory_id) AS n FROM (VALUES ('active'), ('retired')) s(state) LEFT JOIN memories m ON m.state = s.state GROUP BY s.state")
def count_by_state(spark, d):
    return audit.count_by_state(_memories(spark, d))


@query(f"""WITH v AS (SELECT doc_id, source, {NORMAL.format('text')} AS t FROM documents)
    SELECT min(doc_id) AS memory_id, count(DISTINCT source) AS recurrence FROM v GROUP BY t""")
def recurrence(spark, d):
    chain = store.version_chain(_versions(spark, d))
    return store.recurrence(chain)


@query(f"""WITH {MEMORIES}, v AS (SELECT *, {NORMAL.format('text')} AS normalized_text FROM memories)
    SELECT min(memory_id) AS memory_id, arg_min(kind, memory_id) AS kind, max(memory_id) AS current_version_id, count(*) AS versions, count(DISTINCT source) AS recurrence, sha256(normalized_text) AS text_hash
    FROM v GROUP BY normalized_text""")
def dedupe_create(spark, d):
    out = store.dedupe_creates(_versions(spark, d))
    return out.select("memory_id", "kind", "current_version_id", "versions", "recurrence", F.sha2("normalized_text", 256).alias("text_hash"))


@query(f"""WITH v AS (SELECT doc_id AS version_id, {NORMAL.format('text')} AS t FROM documents)
    SELECT version_id, min(version_id) OVER (PARTITION BY t) AS memory_id, lag(version_id) OVER (PARTITION BY t ORDER BY version_id) AS previous_version_id FROM v""")
def version_chain(spark, d):
    return store.version_chain(_versions(spark, d)).select("version_id", "memory_id", "previous_version_id")


@query(f"""WITH {MEMORIES}, v AS (SELECT *, {NORMAL.format('text')} AS t FROM memories), m AS (SELECT min(memory_id) AS memory_id, max(memory_id) AS current_version_id, count(DISTINCT source) AS recurrence FROM v GROUP BY t)
    SELECT m.memory_id, m.current_version_id, m.recurrence, substr(sha256(d.text), 1, 32) AS content_hash FROM m JOIN documents d ON d.doc_id = m.current_version_id""")
def current_version(spark, d):
    chain = store.version_chain(_versions(spark, d))
    memories = chain.groupBy("memory_id").agg(F.max("version_id").alias("current_version_id"))
    return store.hydrate(memories, chain).select("memory_id", "current_version_id", "recurrence", T.content_hash(F.col("text")).alias("content_hash"))


@query("""WITH v AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS place, count(*) OVER (PARTITION BY user_id) AS total FROM events)
    SELECT event_id AS version_id, place::INTEGER AS place, CASE WHEN total > 7 THEN 7 END AS next_offset FROM v WHERE user_id = (SELECT min(user_id) FROM events) AND place >= 2 AND place < 7""")
def open_page(spark, d):
    events = _table(spark, d, "events").select(F.col("user_id").alias("memory_id"), F.col("event_id").alias("version_id"))
    first = events.agg(F.min("memory_id")).first()[0]
    return audit.page(events, first, offset=2, size=5).select("version_id", F.col("place").cast("int").alias("place"), "next_offset")


@query(f"SELECT doc_id, sha256({NORMAL.format('text')}) AS normalized FROM documents")
def normalize_text(spark, d):
    return _table(spark, d, "documents").select("doc_id", F.sha2(T.normalise(F.col("text")), 256).alias("normalized"))


@query(f"SELECT doc_id, len({TERMS.format('text')}) AS n_terms, sha256(array_to_string({TERMS.format('text')}, ' ')) AS terms FROM documents")
def tokenize_terms(spark, d):
    terms = T.terms(F.col("text"))
    return _table(spark, d, "documents").select("doc_id", F.size(terms).cast("long").alias("n_terms"), F.sha2(F.array_join(terms, " "), 256).alias("terms"))


@query("SELECT doc_id, substr(sha256(text), 1, 32) AS content_hash FROM documents")
def content_hash(spark, d):
    return _table(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT doc_id, greatest(1, CAST(ceil(length(text) / 4.0) AS BIGINT)) AS tokens FROM documents")
def token_estimate(spark, d):
    return _table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT doc_id, CASE WHEN length(text) <= 401 THEN text ELSE left(text, 201) || '…[' || (length(text) - 401) || ' chars omitted]…' || right(text, 200) END AS cut FROM documents")
def truncate_edges(spark, d):
    return _table(spark, d, "documents").select("doc_id", T.keep_edges(F.col("text"), 401).alias("cut"))


def _redact_sql(x: str) -> str:
    # RE2's \b is the ASCII word boundary that the Java patterns spell out.
    for pattern, instead in (
        (r"\bBearer\s+[A-Za-z0-9._~+/=-]{8,}\b", "[REDACTED_BEARER_TOKEN]"),
        (r"\b(?:api[_-]?key|apikey|token|secret|password|passwd|authorization)\s*[:=]\s*['\"]?[^\s'\"]{8,}['\"]?", "[REDACTED_SECRET]"),
    ):
        x = f"regexp_replace({x}, {_sql_text(pattern)}, '{instead}', 'gi')"
    return x


@query(f"SELECT doc_id, sha256({_redact_sql('text')}) AS redacted, contains({_redact_sql('text')}, '[REDACTED_') AS had_secret FROM documents")
def redact_secrets(spark, d):
    clean = T.redact(F.col("text"))
    return _table(spark, d, "documents").select("doc_id", F.sha2(clean, 256).alias("redacted"), F.contains(clean, F.lit("[REDACTED_")).alias("had_secret"))


@query("""WITH t AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents)
    SELECT doc_id, CASE WHEN t = '' THEN 'Memory text must be non-empty' WHEN contains(t, chr(10)) THEN 'Memory text must be a single line' WHEN length(t) > 400 THEN 'Memory text exceeds 400 characters' END AS error FROM t""")
def validate_body(spark, d):
    return _table(spark, d, "documents").select("doc_id", T.body_error(F.col("text")).alias("error"))


@query(f"WITH {MEMORIES} SELECT memory_id, '- M:' || memory_id || ' (' || kind || CASE WHEN state = 'active' THEN '' ELSE ', ' || state END || ', r=1): ' || text AS line FROM memories")
def payload_render(spark, d):
    return _memories(spark, d).select("memory_id", T.payload_line(F.col("memory_id"), F.col("kind"), F.col("state"), F.lit(1), F.col("text")).alias("line"))


_ASKED = "(SELECT doc_id AS query_id, text FROM documents WHERE doc_id % 100 = 0)"
_SEGMENT = LIMITS.query_segment_chars
BM25 = f"""tokens AS (SELECT doc_id, {SEARCH_TERMS.format('text')} AS terms FROM documents),
    stats AS (SELECT count(*) AS n_docs, avg(len(terms)) AS avg_len FROM tokens),
    asked AS (SELECT query_id, segment_no, term, count(*) AS times FROM (SELECT query_id, segment_no, unnest({SEARCH_TERMS.format('text')}) AS term FROM segments) GROUP BY ALL),
    exploded AS (SELECT doc_id, len(terms) AS doc_len, unnest(terms) AS term FROM tokens),
    postings AS (SELECT doc_id, doc_len, term, count(*) AS tf FROM exploded WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
    idf AS (SELECT term, CASE WHEN ln((n_docs - count(*) + 0.5) / (count(*) + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - count(*) + 0.5) / (count(*) + 0.5)) END AS idf FROM postings, stats GROUP BY term, n_docs),
    hits AS (SELECT query_id, segment_no, doc_id AS node_id, sum(gain ORDER BY gain) AS score
        FROM (SELECT a.query_id, a.segment_no, p.doc_id, a.times * i.idf * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.doc_len / s.avg_len)) AS gain FROM postings p JOIN idf i ON p.term = i.term JOIN asked a ON a.term = p.term, stats s) GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, segment_no ORDER BY round(score * pow(10, 11 - floor(log10(score)))) / pow(10, 11 - floor(log10(score))) DESC, node_id) AS rank FROM hits)"""
WHOLE = f"segments AS (SELECT query_id, 0 AS segment_no, text FROM {_ASKED})"


@query(f"WITH {WHOLE}, {BM25} SELECT query_id, node_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM ranked WHERE rank <= 100")
def bm25_search(spark, d):
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("node_id"), "text")
    hits = lexical.bm25(docs, _searches(spark, d).withColumn("segment_no", F.lit(0)), most=100)
    return lexical.ranked(hits, most=100).select("query_id", "node_id", "rank", F.round("score", 6).alias("score"))


_PIECES = f"""pieces AS (SELECT query_id, unnest(list_filter([regexp_replace(s, '^\\s+|\\s+$', '', 'g') FOR s IN string_split_regex(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+')], lambda s: s <> '')) AS s,
        generate_subscripts(list_filter([regexp_replace(s, '^\\s+|\\s+$', '', 'g') FOR s IN string_split_regex(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+')], lambda s: s <> ''), 1) AS n FROM {_ASKED})"""


@query(f"""WITH RECURSIVE {_PIECES}, f AS (SELECT query_id, n, s, CASE WHEN length(s) > {_SEGMENT} THEN 0 ELSE length(s) END AS chars, 0 AS segment_no FROM pieces WHERE n = 1
        UNION ALL SELECT p.query_id, p.n, p.s,
            CASE WHEN length(p.s) > {_SEGMENT} THEN 0 WHEN f.chars = 0 OR f.chars + 1 + length(p.s) > {_SEGMENT} THEN length(p.s) ELSE f.chars + 1 + length(p.s) END,
            CASE WHEN length(p.s) > {_SEGMENT} OR f.chars = 0 OR f.chars + 1 + length(p.s) > {_SEGMENT} THEN f.segment_no + 1 ELSE f.segment_no END
        FROM f JOIN pieces p ON p.query_id = f.query_id AND p.n = f.n + 1),
    segments AS (SELECT query_id, segment_no, string_agg(s, ' ' ORDER BY n) AS text FROM f GROUP BY ALL), {BM25},
    kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY segment_no, rank) AS q FROM ranked WHERE rank <= 600)
    SELECT query_id, node_id, CAST(min(rank) AS INTEGER) AS rank FROM kept WHERE q <= 600 GROUP BY ALL""")
def bm25_multi_segment(spark, d):
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("node_id"), "text")
    parts = retrieval.segmented(_searches(spark, d))
    return lexical.quota(lexical.ranked(lexical.bm25(docs, parts, most=600, shared=True), most=600), most=600)


def _cosines(spark, d, floor):
    rows = _table(spark, d, "embeddings")
    stored = rows.select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vector"))
    asked = rows.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.lit(0).alias("segment_no"), F.col("embedding").alias("vector"))
    return vectors.cosine_hits(stored, asked, floor)


COSINES = """c AS (SELECT q.vec_id AS query_id, 0 AS segment_no, v.vec_id AS node_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0),
    near AS (SELECT *, row_number() OVER (PARTITION BY query_id, segment_no ORDER BY round(score, 9) DESC, node_id) AS rank FROM c WHERE score >= 0.15)"""


@query(f"WITH {COSINES} SELECT query_id, node_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM near WHERE rank <= 10")
def cosine_topk(spark, d):
    return vectors.ranked(_cosines(spark, d, 0.15), most=10).select("query_id", "node_id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {COSINES} SELECT query_id, count(*) AS hits, round(min(score), 6) AS lowest FROM near GROUP BY query_id")
def cosine_floor(spark, d):
    return _cosines(spark, d, 0.15).groupBy("query_id").agg(F.count("*").alias("hits"), F.round(F.min("score"), 6).alias("lowest"))


@query("""WITH c AS (SELECT q.vec_id // 100 // 2 AS query_id, q.vec_id // 100 % 2 AS segment_no, v.vec_id AS node_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0),
    near AS (SELECT *, row_number() OVER (PARTITION BY query_id, segment_no ORDER BY round(score, 9) DESC, node_id) AS rank FROM c WHERE score >= 0.15)
    SELECT query_id, node_id, CAST(min(rank) AS INTEGER) AS rank, round(arg_min(score, rank * 10 + segment_no), 6) AS score FROM near GROUP BY query_id, node_id""")
def semantic_best_rank(spark, d):
    pairs = _cosines(spark, d, 0.15).withColumns({"segment_no": (F.floor(F.col("query_id") / 100) % 2).cast("int"), "query_id": F.floor(F.col("query_id") / 200).cast("long")})
    return vectors.best_over_segments(vectors.ranked(pairs)).select("query_id", "node_id", "rank", F.round("score", 6).alias("score"))


FUSED = f"""{WHOLE}, {BM25}, {COSINES},
    lex AS (SELECT query_id, node_id, rank AS lexical_rank FROM ranked WHERE rank <= 600),
    sem AS (SELECT query_id, node_id, rank AS semantic_rank, score AS semantic_score FROM near),
    fused AS (SELECT coalesce(l.query_id, s.query_id) AS query_id, coalesce(l.node_id, s.node_id) AS node_id, lexical_rank, semantic_rank, semantic_score,
        coalesce(1.0 / (60 + lexical_rank), 0.0) + coalesce(1.0 / (60 + semantic_rank), 0.0) AS score FROM lex l FULL JOIN sem s ON l.query_id = s.query_id AND l.node_id = s.node_id)"""


def _fused(spark, d):
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("node_id"), "text")
    found = lexical.ranked(lexical.bm25(docs, _searches(spark, d).withColumn("segment_no", F.lit(0)), most=600), most=600)
    return retrieval.fuse(found, vectors.ranked(_cosines(spark, d, 0.15)))


@query(f"WITH {FUSED} SELECT query_id, node_id, CAST(lexical_rank AS INTEGER) AS lexical_rank, CAST(semantic_rank AS INTEGER) AS semantic_rank, round(semantic_score, 6) AS semantic_score, round(score, 9) AS score FROM fused")
def rrf_hybrid(spark, d):
    return _fused(spark, d).select("query_id", "node_id", "lexical_rank", "semantic_rank", F.round("semantic_score", 6).alias("semantic_score"), F.round("score", 9).alias("score"))


@query(f"""WITH {FUSED}, lines AS (SELECT f.query_id, f.node_id, f.score, length('- M:' || f.node_id || ' (fact, r=1): ' || d.text) AS chars FROM fused f JOIN documents d ON d.doc_id = f.node_id),
    run AS (SELECT *, row_number() OVER w AS unit, sum(chars) OVER w AS total FROM lines WINDOW w AS (PARTITION BY query_id ORDER BY round(score, 12) DESC, node_id ROWS UNBOUNDED PRECEDING))
    SELECT query_id, node_id, chars FROM run WHERE unit <= 150 AND total <= 40000""")
def payload_prefix(spark, d):
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("node_id"), "text")
    line = T.payload_line(F.col("node_id"), F.lit("fact"), F.lit("active"), F.lit(1), F.col("text"))
    sizes = docs.select("node_id", F.length(line).cast("long").alias("chars"))  # of each document once, not of each hit
    unknown = _table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id")).join(docs, "node_id", "left_anti").count()
    lines = retrieval.leading(_fused(spark, d), LIMITS.payload_units, unknown).join(sizes, "node_id")
    return budgets.prefix_budget(lines, ["query_id"], [F.desc(F.round("score", 12)), "node_id"], "chars", LIMITS.payload_chars, LIMITS.payload_units).select("query_id", "node_id", "chars")


# Sessions of `conversations` stand for lists that a budget works on: one list a conversation.
_ITEMS = "items AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, {0} AS len FROM conversations)"


def _lists(spark, d, *columns):
    rows = _table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", *columns))).alias("items"))
    return rows


@query(f"""WITH RECURSIVE {_ITEMS.format('length(text)')}, f AS (SELECT conv_id, n, turn, CASE WHEN len <= 300 THEN len ELSE 0 END AS used, CASE WHEN len <= 300 THEN 1 ELSE 0 END AS units, len <= 300 AS kept FROM items WHERE n = 1
        UNION ALL SELECT i.conv_id, i.n, i.turn, CASE WHEN f.used + i.len <= 300 AND f.units < 3 THEN f.used + i.len ELSE f.used END, CASE WHEN f.used + i.len <= 300 AND f.units < 3 THEN f.units + 1 ELSE f.units END, f.used + i.len <= 300 AND f.units < 3
        FROM f JOIN items i ON i.conv_id = f.conv_id AND i.n = f.n + 1)
    SELECT conv_id, turn FROM f WHERE kept""")
def cap_greedy_skip(spark, d):
    rows = _table(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("chars"))
    return budgets.greedy_rows(rows, ["conv_id"], ["turn"], "chars", 300, 3).select("conv_id", "turn")


@query(f"""WITH RECURSIVE items AS (SELECT conv_id, turn, '- M:' || turn || ' (preference): ' || text AS line, length('- M:' || turn || ' (preference): ' || text) AS len, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
    f AS (SELECT conv_id, n, line, CASE WHEN len <= 400 THEN len ELSE 0 END AS used, len <= 400 AS kept FROM items WHERE n = 1
        UNION ALL SELECT i.conv_id, i.n, i.line, CASE WHEN f.used + i.len <= 400 THEN f.used + i.len ELSE f.used END, f.used + i.len <= 400 FROM f JOIN items i ON i.conv_id = f.conv_id AND i.n = f.n + 1)
    SELECT conv_id, concat_ws(chr(10), string_agg(line, chr(10) ORDER BY n) FILTER (kept), CASE WHEN count(*) FILTER (NOT kept) > 0 THEN '… and ' || count(*) FILTER (NOT kept) || ' more (see /memory list for all)' END) AS section FROM f GROUP BY conv_id""")
def preferences_section(spark, d):
    lines = _lists(spark, d, T.preference_line(F.col("turn"), F.col("text")).alias("line"))
    kept = F.transform(budgets.greedy_budget(F.col("items"), lambda x: F.length(x["line"]), 400), lambda x: x["line"])
    over = F.size("items") - F.size(kept)
    more = F.when(over > 0, F.concat(F.lit("… and "), over.cast("string"), F.lit(" more (see /memory list for all)")))
    return lines.select("conv_id", F.array_join(F.filter(F.concat(kept, F.array(more)), lambda x: x.isNotNull()), "\n").alias("section"))


_SENTENCES = """sentences AS (SELECT conv_id, turn, unnest(p) AS s, generate_subscripts(p, 1) AS n FROM
    (SELECT conv_id, turn, list_filter([regexp_replace(s, '^\\s+|\\s+$', '', 'g') FOR s IN string_split_regex(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+')], lambda s: s <> '') AS p FROM conversations))"""


@query(f"""WITH RECURSIVE {_SENTENCES}, f AS (SELECT conv_id, turn, n, s, CASE WHEN length(s) > 120 THEN 0 ELSE length(s) END AS chars, 0 AS segment_no FROM sentences WHERE n = 1
        UNION ALL SELECT p.conv_id, p.turn, p.n, p.s,
            CASE WHEN length(p.s) > 120 THEN 0 WHEN f.chars = 0 OR f.chars + 1 + length(p.s) > 120 THEN length(p.s) ELSE f.chars + 1 + length(p.s) END,
            CASE WHEN length(p.s) > 120 OR f.chars = 0 OR f.chars + 1 + length(p.s) > 120 THEN f.segment_no + 1 ELSE f.segment_no END
        FROM f JOIN sentences p ON p.conv_id = f.conv_id AND p.turn = f.turn AND p.n = f.n + 1)
    SELECT conv_id, turn, CAST(segment_no AS INTEGER) AS segment_no, string_agg(s, ' ' ORDER BY n) AS segment FROM f GROUP BY conv_id, turn, segment_no""")
def query_segments(spark, d):
    return _table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(retrieval.segments(F.col("text"), 120)).alias("segment_no", "segment"))


_LINE = f"'[' || turn || '] ' || role || ':' || chr(10) || {_redact_sql('text')}"


@query(f"""WITH RECURSIVE items AS (SELECT conv_id, turn, {_LINE} AS line, length({_LINE}) AS len, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
    f AS (SELECT conv_id, turn, n, line, len, len AS chars, 1 AS msgs, 0 AS segment_no FROM items WHERE n = 1
        UNION ALL SELECT i.conv_id, i.turn, i.n, i.line, i.len, CASE WHEN f.chars + i.len > 900 OR f.msgs >= 4 THEN i.len ELSE f.chars + i.len END, CASE WHEN f.chars + i.len > 900 OR f.msgs >= 4 THEN 1 ELSE f.msgs + 1 END, CASE WHEN f.chars + i.len > 900 OR f.msgs >= 4 THEN f.segment_no + 1 ELSE f.segment_no END
        FROM f JOIN items i ON i.conv_id = f.conv_id AND i.n = f.n + 1)
    SELECT conv_id, CAST(segment_no AS INTEGER) AS segment_no, min(turn) AS start_index, max(turn) + 1 AS end_index, string_agg(line, chr(10) || chr(10) ORDER BY n) AS text, CAST(sum(len) AS BIGINT) AS chars FROM f GROUP BY conv_id, segment_no""")
def evidence_segments(spark, d):
    from loam.sources import transcripts

    line = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("] "), F.col("role"), F.lit(":\n"), T.redact(F.col("text")))
    lines = _table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("index"), line.alias("line"))
    return transcripts.pack(lines, 900, 4).withColumnRenamed("session", "conv_id")


@query("""WITH t AS (SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM conversations)
    SELECT conv_id, turn, length(t) < 3 OR (t <> '' AND regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '^(hi|hey|hello|yo|sup|howdy|hola|hiya|greetings|good\\s+(morning|afternoon|evening|day))\\b', ' ', 'i'), 'what''?s?\\s+up\\b', ' ', 'gi'), 'how\\s+(are\\s+you|are\\s+things|do\\s+you\\s+do)\\b', ' ', 'gi'), '[^\\p{L}\\p{N}]+', '', 'g') = '') AS skipped FROM t""")
def greeting_skip(spark, d):
    return _table(spark, d, "conversations").select("conv_id", "turn", T.skips_retrieval(F.col("text")).alias("skipped"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS index FROM conversations WHERE role <> 'system' AND text <> ''")
def visible_evidence(spark, d):
    from loam.sources import transcripts

    part = F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("tool"), F.col("text").alias("text"))
    rows = _table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("position"), F.when(F.col("role") == "system", "custom").otherwise(F.col("role")).alias("role"), F.when(F.col("text") != "", F.array(part)).otherwise(F.filter(F.array(part), lambda p: F.lit(False))).alias("parts"))
    return transcripts.visible(rows).select(F.col("session").alias("conv_id"), F.col("position").alias("turn"), F.col("index").cast("long").alias("index"))


@query("SELECT conv_id, count(*) AS evidence FROM conversations WHERE role <> 'system' AND text <> '' GROUP BY conv_id")
def evidence_count(spark, d):
    return visible_evidence(spark, d).groupBy("conv_id").agg(F.count("*").alias("evidence"))


# Orders stand for session files of customers' workspaces; every second order has a checkpoint, some of them old, partial or of another hash.
def _sessions(spark, d):
    orders = _table(spark, d, "orders").select(F.col("o_custkey").alias("workspace_id"), F.col("o_orderkey").cast("string").alias("session_id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("mtime_ms"), F.sha2("o_orderpriority", 256).alias("content_hash"), F.col("o_orderkey").alias("k"))
    marks = orders.filter("k % 2 = 0").select("session_id", F.when(F.col("k") % 3 == 0, F.col("mtime_ms") - 1).otherwise(F.col("mtime_ms")).alias("mtime_ms"), F.when(F.col("k") % 7 == 0, F.lit(None)).when(F.col("k") % 5 == 0, "other").otherwise(F.col("content_hash")).alias("content_hash"), (F.col("k") % 4).alias("offset"), (F.col("k") % 8 - F.col("k") % 2).alias("total"))
    return orders.drop("k"), marks


_SESSIONS = """s AS (SELECT o_custkey AS workspace_id, CAST(o_orderkey AS VARCHAR) AS session_id, epoch_ms(o_orderdate) AS mtime_ms, sha256(o_orderpriority) AS content_hash, o_orderkey AS k FROM orders),
    c AS (SELECT session_id, CASE WHEN k % 3 = 0 THEN mtime_ms - 1 ELSE mtime_ms END AS c_mtime, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 5 = 0 THEN 'other' ELSE content_hash END AS c_hash, k % 4 AS off, k % 8 - k % 2 AS total FROM s WHERE k % 2 = 0)"""


@query(f"""WITH {_SESSIONS}, e AS (SELECT s.*, CASE WHEN c.session_id IS NULL OR c_mtime < mtime_ms OR (total > 0 AND off < total) THEN false WHEN c_hash IS NULL THEN true ELSE c_hash = content_hash END AS current FROM s LEFT JOIN c ON s.session_id = c.session_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY mtime_ms DESC, session_id) AS place FROM e WHERE NOT current)
    SELECT workspace_id, session_id, CAST(place AS INTEGER) AS place FROM r WHERE place <= 5""")
def eligible_sessions(spark, d):
    files, marks = _sessions(spark, d)
    return control.due(files, marks, most=5).select("workspace_id", "session_id", "place")


@query(f"WITH {_SESSIONS} SELECT s.session_id FROM s LEFT JOIN c ON s.session_id = c.session_id WHERE c.session_id IS NULL OR c_hash IS DISTINCT FROM content_hash OR c_mtime < mtime_ms")
def uncheckpointed(spark, d):
    return control.uncovered(*_sessions(spark, d)).select("session_id")


@query("""SELECT doc_id AS node_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e JOIN documents o ON o.doc_id = e.vec_id WHERE e.vec_id = d.doc_id AND e.label % 2 = 0)""")
def stale_embeddings(spark, d):
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("node_id"), "text")
    have = _table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), "label").join(docs, "node_id")
    have = have.select("node_id", F.lit("m").alias("model_id"), F.when(F.col("label") % 2 == 0, T.content_hash(F.col("text"))).otherwise("old").alias("content_hash"))
    return vectors.stale(docs, have, "m").select("node_id")


# Events stand for runs: type gives status.
def _runs(spark, d):
    status = F.when(F.col("event_type") == "signup", "claimed").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "error", "failed").otherwise("completed")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return _table(spark, d, "events").select(F.col("user_id").alias("workspace_id"), F.col("event_id").alias("run_id"), status.alias("status"), ms.alias("started_ms"), (ms + 1000).alias("finished_ms"), (F.col("event_id") % 3 == 0).alias("reported"))


_RUNS = """r AS (SELECT user_id AS workspace_id, event_id AS run_id, CASE event_type WHEN 'signup' THEN 'claimed' WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status,
    epoch_ms(ts) AS started_ms, epoch_ms(ts) + 1000 AS finished_ms, event_id % 3 = 0 AS reported FROM events)"""


def _now(spark, d):
    return _table(spark, d, "events").agg(F.max(F.unix_millis(F.col("ts").cast("timestamp")))).first()[0]


@query(f"""WITH {_RUNS}, t AS (SELECT max(epoch_ms(ts)) AS now FROM events)
    SELECT workspace_id, count(*) FILTER (status IN ('claimed', 'running') AND now - started_ms < 86400000) = 0 AS may_claim, count(*) FILTER (status IN ('claimed', 'running') AND now - started_ms >= 86400000) AS stale_runs FROM r, t GROUP BY workspace_id""")
def run_claims(spark, d):
    return control.claimable(_runs(spark, d), _now(spark, d), 86_400_000)


@query(f"""WITH {_RUNS}, t AS (SELECT max(epoch_ms(ts)) AS now FROM events)
    SELECT workspace_id, arg_max(run_id, (started_ms, run_id)) AS run_id FROM r, t WHERE status IN ('claimed', 'running') AND NOT now - started_ms > 86400000 GROUP BY workspace_id""")
def active_runs(spark, d):
    return control.active_run(_runs(spark, d), _now(spark, d), 86_400_000)


# Each workspace asks for two runs, of which one is granted at most.
@query(f"""WITH {_RUNS}, t AS (SELECT max(epoch_ms(ts)) AS now FROM events), w AS (SELECT workspace_id, count(*) FILTER (status IN ('claimed', 'running') AND now - started_ms < 86400000) = 0 AS granted FROM r, t GROUP BY workspace_id)
    SELECT workspace_id, run_id, CASE WHEN granted AND status IN ('claimed', 'running') THEN 'failed' ELSE status END AS status, true AS ended FROM r JOIN w USING (workspace_id)
    UNION ALL SELECT workspace_id, -workspace_id - 1, 'claimed', false FROM w WHERE granted""")
def acquire_claims(spark, d):
    runs = _runs(spark, d)
    claims = runs.select("workspace_id", F.explode(F.array(-F.col("workspace_id"), -F.col("workspace_id") - 1)).alias("run_id"))
    return control.acquire(runs, claims, _now(spark, d), 86_400_000).select("workspace_id", "run_id", "status", F.col("finished_ms").isNotNull().alias("ended"))


@query(f"""WITH {_RUNS}, n AS (SELECT workspace_id, arg_min(run_id, (finished_ms, run_id)) AS run_id FROM r WHERE status IN ('completed', 'failed') AND NOT reported GROUP BY workspace_id)
    SELECT r.run_id, r.reported OR n.run_id IS NOT NULL AS reported FROM r LEFT JOIN n ON n.run_id = r.run_id""")
def report_next(spark, d):
    return control.report_next(_runs(spark, d)).select("run_id", "reported")


@query(f"WITH {_RUNS} SELECT workspace_id, run_id, CAST(row_number() OVER (PARTITION BY workspace_id ORDER BY finished_ms, run_id) AS INTEGER) AS place FROM r WHERE status IN ('completed', 'failed') AND NOT reported")
def unreported_runs(spark, d):
    return control.unreported(_runs(spark, d)).select("workspace_id", "run_id", "place")


@query(f"""WITH {_RUNS}, t AS (SELECT max(epoch_ms(ts)) AS now FROM events),
    s AS (SELECT workspace_id, count(*) AS turns, coalesce(max(finished_ms) FILTER (status = 'completed'), 0) AS ok, coalesce(max(finished_ms) FILTER (status = 'failed'), 0) AS bad FROM r GROUP BY workspace_id)
    SELECT workspace_id, turns + 1 AS turns, turns + 1 >= 10 AND (ok = 0 OR (now - ok) / 60000.0 >= 120) AND (NOT (bad > 0 AND bad > ok) OR (now - bad) / 60000.0 >= 120) AND workspace_id % 2 = 0 AS due FROM s, t""")
def cadence_due(spark, d):
    last = lambda s: F.coalesce(F.max(F.when(F.col("status") == s, F.col("finished_ms"))), F.lit(0))
    state = _runs(spark, d).groupBy("workspace_id").agg(F.count("*").alias("turns"), last("completed").alias("last_success_ms"), last("failed").alias("last_failure_ms"))
    state = state.withColumns({"enabled": F.lit(True), "has_due": F.col("workspace_id") % 2 == 0})
    return control.cadence(state, _now(spark, d)).select("workspace_id", "turns", "due")


@query("SELECT max(epoch_ms(o_orderdate)) AS newest_mtime_ms FROM orders")
def max_mtime(spark, d):
    return _sessions(spark, d)[0].agg(F.max("mtime_ms").alias("newest_mtime_ms"))


@query(f"""WITH {MEMORIES} SELECT memory_id FROM memories WHERE state <> 'active' OR memory_id % 7 = 0""")
def cited_revalidation(spark, d):
    memories = _memories(spark, d)
    cited = memories.select("memory_id", F.when(F.col("memory_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return audit.uncited_or_changed(cited, memories).select("memory_id")


@query("SELECT event_type AS source, count(*) AS citations, count(DISTINCT user_id) AS nodes FROM events GROUP BY event_type")
def citation_counts(spark, d):
    return _table(spark, d, "events").groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("citations"), F.countDistinct("user_id").alias("nodes"))


@query(f"""WITH {MEMORIES}, {_RUNS} SELECT (SELECT count(*) FROM memories WHERE state = 'active') AS active, (SELECT count(*) FROM memories WHERE state = 'retired') AS retired, (SELECT count(*) FROM events) AS citations,
    (SELECT count(*) FROM r WHERE status IN ('completed', 'failed') AND NOT reported) AS unreported, (SELECT max(epoch_ms(o_orderdate)) FROM orders) AS newest_mtime_ms""")
def status_counts(spark, d):
    out = audit.status(_memories(spark, d), _table(spark, d, "events"), _runs(spark, d), _sessions(spark, d)[0])
    return out.select("active", "retired", "citations", "unreported", "newest_mtime_ms")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_events(spark, d):
    out = windowed_counts(_table(spark, d, "events"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


# Customers stand for workspaces: some with a remote in one of its three forms, some with a git folder or none.
@query("""WITH c AS (SELECT c_custkey AS k, c_custkey % 5 AS form, c_name AS name FROM customer),
    s AS (SELECT k, name, CASE WHEN form < 3 THEN 'example.com/org ' || k % 7 || '/' || lower(name) WHEN form = 3 THEN '/repos/' || name || '.git' ELSE '/home/' || name || '/' END AS source FROM c),
    b AS (SELECT k, source, regexp_replace(regexp_replace(regexp_extract(regexp_replace(source, '/+$', ''), '([^/]*)$', 1), '(?i)\\.git$', ''), '[^a-zA-Z0-9._-]+', '-', 'g') AS base FROM s)
    SELECT k AS c_custkey, substr(sha256(source), 1, 12) || '_' || left(regexp_replace(base, '^-+|-+$', '', 'g'), 32) AS workspace FROM b""")
def workspace_ids(spark, d):
    c = _table(spark, d, "customer").withColumn("form", F.col("c_custkey") % 5)
    path = F.concat(F.lit("Org "), (F.col("c_custkey") % 7).cast("string"), F.lit("/"), F.col("c_name"))
    forms = (F.concat(F.lit("git@Example.com:"), path, F.lit(".git")), F.concat(F.lit("https://EXAMPLE.com/"), path, F.lit("/")), F.concat(F.lit("ssh://git@example.com/"), path))
    remote = F.when(F.col("form") == 0, forms[0]).when(F.col("form") == 1, forms[1]).when(F.col("form") == 2, forms[2]).when(F.col("form") == 3, "/not a remote")
    common = F.when(F.col("form") == 3, F.concat(F.lit("/repos/"), F.col("c_name"), F.lit(".git")))
    return c.select("c_custkey", T.workspace_id(remote, common, F.concat(F.lit("/home/"), F.col("c_name"), F.lit("/"))).alias("workspace"))


@query("""SELECT doc_id, CASE WHEN greatest(1, ceil(length(text) / 4)) + greatest(1, ceil(length(source) / 4)) + 8000 > 8050 + doc_id % 300 THEN 'context window too small' WHEN doc_id % 9 = 0 THEN 'output limit too small' END AS error FROM documents""")
def synthesis_capacity(spark, d):
    window, most = F.lit(8050) + F.col("doc_id") % 300, F.when(F.col("doc_id") % 9 == 0, 5999)
    return _table(spark, d, "documents").select("doc_id", mining.capacity(F.col("text"), F.col("source"), window, most).alias("error"))


@query(f"""WITH t AS (SELECT conv_id, coalesce(max(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) FILTER (turn = 0), '') AS answer, coalesce(string_agg('- M:' || turn || ' (preference): ' || text, chr(10) ORDER BY turn) FILTER (role = 'user'), '') AS preferences FROM conversations GROUP BY conv_id)
    SELECT conv_id, sha256(concat_ws(chr(10) || chr(10), CASE WHEN answer <> '' THEN {_sql_text(synthesis.CONTEXT_HEADING)} || chr(10) || chr(10) || answer END,
        CASE WHEN preferences <> '' THEN {_sql_text(synthesis.PREFERENCES_HEADING)} || chr(10) || chr(10) || regexp_replace(preferences, '\\s+$', '') END, {_sql_text(synthesis.SEARCH_HINT)})) AS message_hash FROM t""")
def briefing_message(spark, d):
    line = F.when(F.col("role") == "user", F.struct("turn", T.preference_line(F.col("turn"), F.col("text")).alias("line")))
    rows = _table(spark, d, "conversations").groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("answer"), F.array_sort(F.collect_list(line)).alias("lines"))
    preferences = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return rows.select("conv_id", F.sha2(synthesis.briefing_message(preferences, F.col("answer")), 256).alias("message_hash"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid retrieval of all searches, and what fits the payload."""
    return payload_prefix(spark, d)
