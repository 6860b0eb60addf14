"""The queries of this subpackage, each over its whole table, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, html_extract, mixing, negatives, quality, runs, secrets, simhash, topk, toxicity, urls, warc
from .common import read_table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read_table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(read_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT -7L AS conv_id, t AS turn, r AS role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    return chat.read_back(chat.format_conversations(rows.union(more)))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(spark, warc.write_archives(read_table(spark, sf_dir, "pages")))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(read_table(spark, sf_dir, "pages"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label")))


URL_RULES = [("com/", urls.ALLOW), ("example.com/en/", urls.BLOCK), ("www.example.com/en/", urls.ALLOW), ("net/es/", urls.BLOCK), ("net/fr/", urls.BLOCK)]


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", runs.repeated_from(F.col("doc_id"), F.col("text")).alias("text"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("less"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    found = runs.period_runs(docs, digest=True).select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"))
    start, length, period = -F.col("best.before"), F.col("best.length"), -F.col("best.less")
    return found.select("doc_id", "n_words", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash, op2_secrets, op3_mixing, op4_decontamination, op5_chat, op6_warc, op7_html, op8_topk, op9_toxicity, op10_quality, op11_hard_negatives, op12_urls, op13_runs)
}


def _secrets_sql() -> str:
    """Key blocks are stated by their begin line only, which no given table holds."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    kinds = secrets.KINDS | {"pem": secrets.Kind("-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27)}
    found = " UNION ALL ".join(
        f"""SELECT doc, '{kind}' AS kind, {rank} AS rank, length(lead[i]) * {int(k.lead > 0)} AS l, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i-1], lambda x: length(x))), 0) AS s, whole[i] AS w, val[i] AS v
            FROM (SELECT doc, string_split_regex(t, {quoted(k.pattern)}) AS gaps, regexp_extract_all(t, {quoted(k.pattern)}) AS whole, regexp_extract_all(t, {quoted(k.pattern)}, {k.value}) AS val, regexp_extract_all(t, {quoted(k.pattern)}, {k.lead}) AS lead FROM d WHERE regexp_matches(t, {quoted(k.pattern)})), LATERAL (SELECT unnest(range(1, len(whole) + 1)) AS i)
            WHERE length(val[i]) >= {k.least}"""
        for rank, (kind, k) in enumerate(kinds.items())
    )
    base = ", ".join(f"'{k}'" for k in secrets.BASE)
    return f"""
        WITH d AS (SELECT row_number() OVER () AS doc, doc_id, source, coalesce(text, '') AS t FROM documents),
        spans AS ({found}),
        owned AS (SELECT v, count(DISTINCT coalesce(source, chr(1))) AS owners, count(DISTINCT coalesce(source, chr(1)) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS repositories FROM spans JOIN d USING (doc) GROUP BY v),
        each AS (SELECT doc, kind, rank, s + l AS s, kind || ':' || CAST(s + l AS BIGINT) || ':' || CAST(s + length(w) AS BIGINT) AS name, owners < {secrets.SHARED_OWNERS} AND repositories < {secrets.SHARED_REPOSITORIES} AS live, owners || '/' || repositories AS o FROM spans JOIN owned USING (v)),
        byd AS (SELECT doc, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h,
                string_agg(name, ',' ORDER BY s, rank) FILTER (kind IN ({base})) AS b, string_agg(name, ',' ORDER BY s, rank) AS every, string_agg(o, ',' ORDER BY s, rank) AS o,
                count(*) FILTER (live) AS live, count(*) FILTER (NOT live) AS shared FROM each GROUP BY doc)
        SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(every, '') AS spans, coalesce(live, 0) AS n_live, coalesce(shared, 0) AS n_shared, coalesce(o, '') AS ownership
        FROM d LEFT JOIN byd USING (doc)"""


_CONTROL = r"\[\\*(/?INST\]|/?SYS\]|/TURN\]|TURN )|<\\*/?s>"

ORACLE_SQL: dict[str, str] = {
    "op2_secrets": _secrets_sql(),
    "op5_chat": f"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
        t AS (SELECT *, len(regexp_extract_all(text, '{_CONTROL}')) AS controls FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(3 + sum(length(text) + controls + CASE role WHEN 'assistant' THEN 4 WHEN 'user' THEN 13 WHEN 'system' THEN 11 ELSE 14 + length(role) END) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        q AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
        SELECT page_id, payload_bytes,
            list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(x, CAST(i // 4 * 5 + 1 AS BIGINT), 5))::INTEGER >> CAST(15 - i % 4 * 5 AS INTEGER)) % 32 + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
            CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM q""",
    "op8_topk": """
        WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.r <> q.r AND len(c.e) = len(q.e)),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 5""",
    "op11_hard_negatives": """
        WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.r, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.r <> a.r AND len(c.e) = len(a.e)),
        p AS (SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS n FROM s WHERE same),
        g AS (SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.r, p.n ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
              FROM p JOIN s ON s.r = p.r AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score WHERE p.n <= 5)
        SELECT * FROM g WHERE rank <= 10""",
    "op13_runs": f"""
        WITH t AS (SELECT range AS i, list_reduce(list_prepend(range, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256)),
        tab AS (SELECT list(v ORDER BY i) AS tab FROM t),
        d AS (SELECT row_number() OVER () AS uid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS o FROM documents),
        h AS (SELECT d.*, len(o) AS n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda k: CAST(ord(substr(CAST(doc_id AS VARCHAR), k, 1)) AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c & 255, b) + 1)::BIGINT])), 4294967295) AS h FROM d, tab),
        p AS (SELECT *, h // 10 AS g FROM h),
        r AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM p),
        w AS (SELECT uid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_concat(o[1:a], list_transform(range(0, n - a), lambda i: o[a + i % (1 + (n - a) // (3 + g % 8)) + 1])) ELSE o END AS w FROM r),
        x AS (SELECT uid, n, i, w[i + 1] AS v FROM (SELECT uid, n, w, unnest(range(0, n)) AS i FROM w)),
        e AS (SELECT a.uid, b.i - a.i AS q, a.i FROM x a JOIN x b ON a.uid = b.uid AND a.v = b.v AND b.i > a.i AND b.i - a.i <= a.n // {runs.TIMES}),
        g AS (SELECT uid, q, min(i) AS s, count(*) AS m FROM (SELECT uid, q, i, i - row_number() OVER (PARTITION BY uid, q ORDER BY i) AS isle FROM e) GROUP BY uid, q, isle),
        f AS (SELECT uid, q, s, m + q AS l FROM g WHERE m + q >= greatest({runs.LEAST}, {runs.TIMES} * q)),
        u AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f k WHERE k.uid = f.uid AND k.q < f.q AND f.q % k.q = 0 AND k.s <= f.s AND k.s + k.l >= f.s + f.l)),
        z AS (SELECT uid, count(*) AS n_runs, max({{'l': l, 's': -s, 'q': -q}}) AS best, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM u GROUP BY uid),
        gone AS (SELECT DISTINCT uid, unnest(range(s + q, s + l)) AS i FROM u),
        kept AS (SELECT uid, string_agg(v, ' ' ORDER BY i) AS t FROM x ANTI JOIN gone USING (uid, i) GROUP BY uid)
        SELECT doc_id, n AS n_words, coalesce(n_runs, 0) AS n_runs, -best.s AS start, best.l AS length, -best.q AS period, 1000 * best.l // -best.q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
        FROM w LEFT JOIN z USING (uid) LEFT JOIN kept USING (uid)""",
}
