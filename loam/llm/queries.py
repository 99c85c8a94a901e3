"""The queries of this subpackage: each applies an operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import decontamination, divergence, html_text, language_id, line_dedup, media, mixing, sentencepiece_codec, sharding, simhash, topk, toxicity, vector_codes
from loam.llm.common import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), F.array("source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.kept_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.text_media(table(spark, sf_dir, "documents"))
    ranges = F.transform("keyframe_ranges", lambda r: F.concat(r["start"], F.lit("-"), r["end"]))
    return out.withColumn("keyframe_ranges", F.array_join(ranges, ","))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        F.col("__n_hit").alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("__n_hit") > 0).alias("contaminated"),
    )


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sentencepiece, op2_toxicity, op3_html_text, op4_simhash, op5_mixing, op6_topk, op7_line_dedup, op8_language_id, op9_media, op10_sharding, op11_vector_codes, op12_decontamination, op13_divergence)
}



def _u32(n: str) -> str:
    return f"printf('%08x', {n})"


def _u64(n: str) -> str:
    return f"printf('%016x', {n})"


def _crc32(values: str) -> str:
    """SQL: the CRC-32 of a list of bytes."""
    steps = "list_reduce(list_prepend(xor(c, b) & 255, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda t, z: xor(t >> 1, 3988292384 * (t & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {values}), lambda c, b: xor(c >> 8, {steps})), 4294967295)"


def _bytes(digits: str) -> str:
    """SQL: hexadecimal digits as a list of bytes."""
    return f"[CAST('0x' || substr({digits}, 2 * i + 1, 2) AS BIGINT) FOR i IN range(strlen({digits}) // 2)]"


def _container() -> str:
    """SQL: the hexadecimal digits of all that stands before the payload of `n` units, in boxes of stated lengths."""
    x = lambda text: text.encode().hex()
    unity = "00010000" + "0" * 24 + "00010000" + "0" * 24 + "40000000"
    movie = f"'00000078' || '{x('mvhd')}' || '01000000' || '{'0' * 32}' || '00001f40' || {_u64('192 * n')} || '000100000100' || '{'0' * 20}' || '{unity}' || '{'0' * 48}' || '00000002'"
    track = f"'00000068' || '{x('tkhd')}' || '01000007' || '{'0' * 32}' || '0000000100000000' || {_u64('192 * n')} || '{'0' * 16}' || '0000000001000000' || '{unity}' || '{'0' * 16}'"
    mdhd = f"'0000002c' || '{x('mdhd')}' || '01000000' || '{'0' * 32}' || '00001f40' || {_u64('192 * n')} || '55c40000'"
    hdlr = f"'0000002b{x('hdlr')}0000000000000000{x('soun')}{'0' * 24}{x('text bytes')}00'"
    smhd = f"'00000010{x('smhd')}0000000000000000'"
    dinf = f"'00000024{x('dinf')}0000001c{x('dref')}00000000000000010000000c{x('url ')}00000001'"
    stsd = f"'00000034{x('stsd')}000000000000000100000024{x('raw ')}0000000000000001{'0' * 16}000100080000" + "0000" + "1f400000'"
    stts = f"'00000018{x('stts')}0000000000000001' || {_u32('n')} || '000000c0'"
    stss = f"{_u32('16 + 4 * keys')} || '{x('stss')}00000000' || {_u32('keys')} || list_aggregate([printf('%08x', 16 * k + 1) FOR k IN range(keys)], 'string_agg', '')"
    whole = "CASE WHEN n >= 64 THEN '000000010000004000000001' ELSE '' END"
    rest = f"CASE WHEN n % 64 > 0 THEN {_u32('n // 64 + 1')} || {_u32('n % 64')} || '00000001' ELSE '' END"
    stsc = f"{_u32('16 + 12 * runs')} || '{x('stsc')}00000000' || {_u32('runs')} || {whole} || {rest}"
    stsz = f"'00000014{x('stsz')}00000000000000c0' || {_u32('n')}"
    stco = f"{_u32('16 + 4 * chunks')} || '{x('stco')}00000000' || {_u32('chunks')} || list_aggregate([printf('%08x', lead + 12288 * k) FOR k IN range(chunks)], 'string_agg', '')"
    table = f"{_u32('tables')} || '{x('stbl')}' || {stsd} || {stts} || {stss} || {stsc} || {stsz} || {stco}"
    media = f"{_u32('tables + 155')} || '{x('mdia')}' || {mdhd} || {hdlr} || {_u32('tables + 60')} || '{x('minf')}' || {smhd} || {dinf} || {table}"
    moov = f"{_u32('lead - 32')} || '{x('moov')}' || {movie} || {_u32('tables + 267')} || '{x('trak')}' || {track} || {media}"
    return f"'00000018{x('ftyp')}{x('qt  ')}00000000{x('qt  isom')}' || {moov} || {_u32('8 + 192 * n')} || '{x('mdat')}'"


def _lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _round(k: int) -> str:
    """SQL: round k of the codebooks: each part's nearest entry, then the entries' floored means."""
    return f"""
        near{k} AS MATERIALIZED (
            SELECT r, p, CAST(arg_min(e, (d, e)) AS BIGINT) AS e, CAST(min(d) AS BIGINT) AS d
            FROM (SELECT a.r, a.p, b.e, a.xx - 2 * list_inner_product(a.x, b.x) + list_inner_product(b.x, b.x) AS d FROM parts a JOIN book{k} b ON a.p = b.p) GROUP BY r, p),
        sums{k} AS (SELECT p, e, i, sum(CAST(x AS BIGINT)) AS s, count(*) AS n FROM (SELECT p, e, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM near{k} JOIN parts USING (r, p)) GROUP BY p, e, i),
        means{k} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS x FROM sums{k} GROUP BY p, e),
        book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN means{k} m ON b.p = m.p AND b.e = m.e)"""


_SPACE = r"\x20\x09-\x0D"
ORACLE_SQL: dict[str, str] = {
    # Of sources one document each belongs to, the cheapest flow takes the target in whole passes and a rest. Capped sources
    # are those with the least room a unit of weight: `level` is the unit that is left once the first k of them are capped.
    "op5_mixing": f"""
        WITH docs AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+')) AS BIGINT) AS size,
                   CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 15) AS BIGINT) AS place FROM documents),
        sources AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
            FROM docs GROUP BY source),
        ordered AS (SELECT *, row_number() OVER (ORDER BY 2 * source_size / weight, source NULLS LAST) AS k, sum(source_size) OVER () * 3 / 2 AS total FROM sources),
        levels AS (
            SELECT *, (total - coalesce(sum(2 * source_size) OVER before, 0)) / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM ordered WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        open AS (SELECT min(k) AS k, arg_min(level, k) AS unit FROM levels WHERE level * weight <= 2 * source_size),
        targets AS (
            SELECT l.source, source_size, CAST(CASE WHEN l.k < coalesce(o.k, 1e9) THEN 2 * source_size ELSE o.unit * weight END AS DOUBLE) AS target FROM levels l, open o),
        flows AS (SELECT *, least(2 * source_size, CAST(round_even(target, 0) AS BIGINT)) AS flow FROM targets),
        goals AS (
            SELECT source, source_size, target, CASE WHEN source_size > 0 THEN flow // source_size ELSE 0 END AS whole, CASE WHEN source_size > 0 AND flow < 2 * source_size THEN flow % source_size ELSE 0 END AS goal FROM flows),
        run AS (
            SELECT d.*, g.source_size, g.target, g.whole, g.goal, sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING) <= g.goal AS picked
            FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source),
        short AS (SELECT source, any_value(goal) - coalesce(sum(size) FILTER (picked), 0) AS missing FROM run GROUP BY source),
        extra AS (
            SELECT r.source, arg_min(r.doc_id, (abs(r.size - s.missing), r.place, r.doc_id)) AS doc_id FROM run r JOIN short s ON r.source IS NOT DISTINCT FROM s.source
            WHERE NOT r.picked AND r.size > 0 AND abs(r.size - s.missing) < s.missing GROUP BY r.source)
        SELECT r.doc_id, r.size, r.source_size, r.target, CAST(CASE WHEN r.size > 0 THEN r.size * (r.whole + CAST(r.picked OR e.doc_id IS NOT NULL AS BIGINT)) ELSE 0 END AS BIGINT) AS taken
        FROM run r LEFT JOIN extra e ON e.source IS NOT DISTINCT FROM r.source AND e.doc_id = r.doc_id""",
    "op6_topk": """
        WITH whole AS (
            SELECT CAST(vec_id AS BIGINT) AS vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
            FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
        pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
            FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 5""",
    "op7_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        keyed AS (
            SELECT *, translate(regexp_replace(regexp_replace(line, '^[{_SPACE}]+', ''), '[{_SPACE}]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
        firsts AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key),
        marked AS (SELECT k.*, coalesce(f.first < k.doc_id, false) AS lost FROM keyed k LEFT JOIN firsts f ON k.key = f.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    # The container of formats small enough for 32-bit offsets, box by box.
    "op9_media": f"""
        WITH raw AS (SELECT doc_id, coalesce(text, '') AS text, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents),
        units AS (SELECT *, greatest(1, (n_bytes + 191) // 192) AS n FROM raw),
        counts AS (
            SELECT *, encode(text || repeat(' ', 192 * n - n_bytes)) AS payload, (n + 15) // 16 AS keys, (n + 63) // 64 AS chunks,
                   CAST(n >= 64 AS BIGINT) + CAST(n % 64 > 0 AS BIGINT) AS runs FROM units),
        places AS (SELECT *, 152 + 4 * keys + 12 * runs + 4 * chunks AS tables FROM counts),
        leads AS (SELECT *, tables + 427 AS lead FROM places),
        stored AS (SELECT *, unhex({_container()}) || payload AS file, [lead + 3072 * k FOR k IN range(keys)] AS starts, lower(right(hex(payload), 32)) AS tail FROM leads),
        ranged AS (SELECT *, list_aggregate([printf('%016x%016x', a, a + 192) FOR a IN starts], 'string_agg', '') AS packed FROM stored)
        SELECT doc_id, n_bytes, 192 * n AS payload_bytes, sha256(payload) AS payload_sha256, {_crc32(_bytes('tail'))} AS tail_crc32,
               CAST(octet_length(file) AS BIGINT) AS media_bytes, sha256(file) AS media_sha256,
               printf('brand=qt;codec=raw;seconds=%.3f;samples=%d;keyframes=%d;ranges=%s;ranges_crc32=%08x', 192 * n / 8000.0, n, keys,
                      CASE WHEN keys > 1 THEN printf('%d-%d,%d-%d', starts[1], starts[1] + 192, starts[-1], starts[-1] + 192) ELSE printf('%d-%d', starts[1], starts[1] + 192) END,
                      {_crc32(_bytes('packed'))}) AS feature,
               CAST(NULL AS VARCHAR) AS media_error, list_aggregate([printf('%d-%d', a, a + 192) FOR a IN starts], 'string_agg', ',') AS keyframe_ranges
        FROM ranged""",
    # Integers stand in doubles, which hold them exactly at these sizes. Of one length that four divides.
    "op11_vector_codes": f"""
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v, len(embedding) // 4 AS w
            FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
        parts AS MATERIALIZED (SELECT *, list_inner_product(x, x) AS xx FROM (SELECT r, p, v[p * w + 1:(p + 1) * w] AS x FROM kept, range(4) t(p))),
        book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x FROM parts WHERE r <= 256),
        {",".join(_round(k) for k in range(5))},
        coded AS (
            SELECT k.vec_id, k.label, c.code, c.error
            FROM kept k JOIN (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near4 GROUP BY r) c ON k.r = c.r)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) FROM (SELECT p, e, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM book4)) AS codebooks_sha256
        FROM coded""",
    "op12_decontamination": rf"""
        WITH docs AS MATERIALIZED (
            SELECT row_number() OVER () AS d, doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        items AS (
            SELECT CAST(item_id AS VARCHAR) AS item_id, w, least(10, len(w)) AS k
            FROM (SELECT item_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
        windows AS MATERIALIZED (
            SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM items)),
        grams AS (
            SELECT d, k, i, array_to_string(w[i:i + k - 1], ' ') AS t
            FROM (SELECT d, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
        hits AS MATERIALIZED (SELECT d, k, i, t FROM grams WHERE (k, t) IN (SELECT (k, t) FROM windows)),
        hit AS (SELECT d, count(DISTINCT place) AS n FROM (SELECT d, unnest(range(i, i + k)) AS place FROM hits) GROUP BY d),
        found AS (
            SELECT d, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids
            FROM (SELECT DISTINCT h.d, w.item_id FROM hits h JOIN windows w ON h.k = w.k AND h.t = w.t) GROUP BY d)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(f.n, 0) AS n_items, sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
        FROM docs LEFT JOIN hit h ON docs.d = h.d LEFT JOIN found f ON docs.d = f.d""",
    "op13_divergence": rf"""
        WITH docs AS (
            SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        counts AS MATERIALIZED (SELECT d, lang, source, term, count(*) AS n FROM (SELECT d, lang, source, {_lower("unnest(w)")} AS term FROM docs) GROUP BY ALL),
        kept AS MATERIALIZED (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY lang, term HAVING count(*) >= 10),
        sizes AS (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS n FROM kept GROUP BY lang),
        groups AS (SELECT DISTINCT lang, source FROM docs),
        held AS MATERIALIZED (SELECT c.lang, c.source, c.term, CAST(sum(c.n) AS BIGINT) AS n FROM counts c JOIN kept k ON c.lang = k.lang AND c.term = k.term GROUP BY ALL),
        sums AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS n FROM held GROUP BY ALL),
        p AS MATERIALIZED (
            SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n, 1 + (1000000000 * (coalesce(h.n, 0) + 2)) // (coalesce(s.n, 0) + 2 * z.v) AS p, 1 + (1000000000 * (k.n + 2)) // (z.n + 2 * z.v) AS q
            FROM groups g JOIN kept k ON g.lang = k.lang JOIN sizes z ON g.lang = z.lang LEFT JOIN sums s ON g.lang = s.lang AND g.source = s.source
            LEFT JOIN held h ON g.lang = h.lang AND g.source = h.source AND k.term = h.term),
        gaps AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (
            SELECT g.lang, g.source, 'pair' AS part, o.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
            FROM groups g JOIN groups o ON g.lang = o.lang AND g.source <> o.source LEFT JOIN gaps x ON x.lang = g.lang AND x.source = g.source AND x.item = o.source),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10""",
}
