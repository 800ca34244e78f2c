"""The registered queries of the text operators, each over its whole table, with oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxelloom.llm import (align, ann, decontam, linededup, lm, mixing, packing, quality, resample, secrets, simhash,
                           tokens, toxicity, urls)
from voxelloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return keep


def _day(column, mark: str, days: int):
    """A day of 2024 that depends on a text."""
    n = F.conv(F.substring(F.md5(F.concat(F.lit(mark), column)), 1, 7), 16, 10).cast("bigint") % days
    return F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a fetch time derived from the id."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 360).cast("int"))
    return pages.withColumn("fetched", F.timestamp_seconds(
        F.unix_timestamp(day.cast("timestamp")) + F.col("page_id") * 641 % 86400))


def list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dated list log derived from the pages: hosts, first path segments and pages go on and off three lists."""
    target = table(spark, sf_dir, "pages").where("url IS NOT NULL").select(urls.bare(F.col("url")).alias("t"))
    rules = (target.select(F.explode(F.array(
        F.struct(F.lit("host").alias("kind"), F.substring_index("t", "/", 1).alias("rule")),
        F.struct(F.lit("prefix").alias("kind"), F.substring_index("t", "/", 2).alias("rule")),
        F.struct(F.lit("url").alias("kind"), F.col("t").alias("rule")))).alias("r")).select("r.*").distinct())
    key = F.concat_ws("|", "kind", "rule")
    pick = F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("int") % 4
    listed = rules.withColumns({"key": key, "pick": pick}).where("pick < 3")
    name = F.element_at(F.array(F.lit("malware"), F.lit("adult"), F.lit("spam")), F.col("pick") + 1)
    return listed.select(name.alias("list_name"), "kind", "rule", F.explode(F.array(
        F.struct(F.lit("add").alias("action"), _day(F.col("key"), "a", 360).alias("listed")),
        F.struct(F.lit("remove").alias("action"), _day(F.col("key"), "r", 360).alias("listed")),
        F.struct(F.lit("add").alias("action"), _day(F.col("key"), "b", 360).alias("listed")))).alias("e")).select(
        "list_name", "kind", "rule", "e.*")


_BARE = r"""regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/]*)', 1)), '^.*@', ''), ':\d+$', '')
    || regexp_replace(regexp_replace(rest, '^[^/]*', ''), '/+$', '')"""
_OP1 = rf"""
WITH p0 AS (SELECT page_id, url, regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[?#].*$', '') AS rest,
    DATE '2024-01-01' + CAST(page_id * 37 % 360 AS INT) AS day FROM pages),
pg AS (SELECT page_id, url, day, {_BARE} AS t FROM p0),
rules AS (SELECT DISTINCT kind, rule FROM (
    SELECT 'host' AS kind, split_part(t, '/', 1) AS rule FROM pg WHERE url IS NOT NULL UNION ALL
    SELECT 'prefix', array_to_string(string_split(t, '/')[1:2], '/') FROM pg WHERE url IS NOT NULL UNION ALL
    SELECT 'url', t FROM pg WHERE url IS NOT NULL)),
listed AS (SELECT *, kind || '|' || rule AS key, CAST('0x' || substr(md5(kind || '|' || rule), 1, 4) AS INT) % 4 AS pick FROM rules),
log AS (SELECT ['malware', 'adult', 'spam'][pick + 1] AS list_name, kind, rule, e.a AS action,
    DATE '2024-01-01' + CAST(CAST('0x' || substr(md5(e.m || key), 1, 7) AS BIGINT) % 360 AS INT) AS day
  FROM listed, (SELECT unnest([{{'a': 'add', 'm': 'a'}}, {{'a': 'remove', 'm': 'r'}}, {{'a': 'add', 'm': 'b'}}]) AS e) WHERE pick < 3),
days AS (SELECT list_name, kind, rule, day, max(action) = 'add' AS active FROM log GROUP BY ALL),
spans AS (SELECT * FROM (SELECT *, day AS from_day, lead(day) OVER (PARTITION BY list_name, kind, rule ORDER BY day) AS to_day FROM days)
  WHERE active),
probe AS (SELECT DISTINCT page_id, day, 'url' AS kind, t AS rule FROM pg WHERE url IS NOT NULL UNION
  SELECT page_id, day, 'host', array_to_string(string_split(split_part(t, '/', 1), '.')[i:], '.')
    FROM pg, (SELECT unnest(range(1, 30)) AS i) WHERE url IS NOT NULL AND i <= len(string_split(split_part(t, '/', 1), '.')) UNION
  SELECT page_id, day, 'prefix', array_to_string(string_split(t, '/')[1:i], '/')
    FROM pg, (SELECT unnest(range(1, 60)) AS i) WHERE url IS NOT NULL AND i <= len(string_split(t, '/'))),
hits AS (SELECT p.page_id, s.list_name, p.kind, p.rule FROM probe p JOIN spans s ON p.kind = s.kind AND p.rule = s.rule
    AND s.from_day <= p.day AND (s.to_day IS NULL OR p.day < s.to_day)),
found AS (SELECT page_id, count(DISTINCT list_name) AS n_lists, string_agg(DISTINCT list_name, ',' ORDER BY list_name) AS lists FROM hits GROUP BY 1),
best AS (SELECT page_id, rule FROM hits QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, kind DESC, rule DESC) = 1)
SELECT page_id, coalesce(n_lists, 0) AS n_lists, coalesce(lists, '') AS lists, rule, coalesce(n_lists, 0) > 0 AS blocked
FROM pages LEFT JOIN found USING (page_id) LEFT JOIN best USING (page_id)"""


@query("op1_url_filter", _OP1)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = captures(spark, sf_dir)
    verdict = urls.judge(seen, list_entries(spark, sf_dir)).withColumnsRenamed({"url": "u", "fetched": "f"})
    return (seen.join(verdict, F.col("url").eqNullSafe(F.col("u")) & F.col("fetched").eqNullSafe(F.col("f")))
            .select("page_id", "n_lists", "lists", "rule", (F.col("n_lists") > 0).alias("blocked")))


@query("op2_nearest")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"))


_OP3 = r"""
WITH line AS (SELECT doc_id, CAST(i - 1 AS INT) AS line, list_distinct(list_filter(regexp_split_to_array(
    translate(string_split(text, chr(10))[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda w: w <> '')) AS words
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE doc_id IS NOT NULL)),
big AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id, line) AS k, len(words) AS n FROM line WHERE len(words) >= 1),
word AS (SELECT k, n, unnest(words) AS w FROM big),
freq AS (SELECT w, count(*) AS f FROM word GROUP BY w),
placed AS (SELECT k, n, w, row_number() OVER (PARTITION BY k ORDER BY f, w) AS place FROM word JOIN freq USING (w)),
head AS MATERIALIZED (SELECT k, n, w FROM placed WHERE place <= n - CAST(ceil(n * 0.8) AS INT) + 1),
pair AS (SELECT DISTINCT a.k AS k, b.k AS j FROM head a JOIN head b ON a.w = b.w AND b.k < a.k AND a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4),
gone AS (SELECT DISTINCT k FROM pair JOIN big a USING (k) JOIN big b ON b.k = pair.j
  WHERE 5 * len(list_intersect(a.words, b.words)) >= 4 * (a.n + b.n - len(list_intersect(a.words, b.words)))),
cut AS (SELECT doc_id, list(line) AS lines FROM gone JOIN big USING (k) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS INT) AS n_lines, CAST(coalesce(len(lines), 0) AS INT) AS n_removed,
  md5(CASE WHEN lines IS NULL THEN text ELSE coalesce(array_to_string([x FOR x, i IN string_split(text, chr(10)) IF NOT list_contains(lines, i - 1)], chr(10)), '') END) AS text_md5
FROM documents LEFT JOIN cut USING (doc_id) WHERE doc_id IS NOT NULL"""


@query("op3_line_dedup", _OP3)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


@query("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_secrets")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.secrets(table(spark, sf_dir, "documents")))


@query("op6_near_duplicates")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_lm_score")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


@query("op8_contamination")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op10_sql() -> str:
    """The same sweeps as a chain of views, one per dimension and sweep."""
    views = [r"""doc AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
    CAST(coalesce(len(regexp_extract_all(text, '[^ \t-\r]+')), 0) AS BIGINT) AS n_tokens FROM documents WHERE doc_id IS NOT NULL)""",
             """topical AS MATERIALIZED (SELECT *, CASE WHEN n_tokens < 150 THEN 'short' WHEN n_tokens < 600 THEN 'medium' ELSE 'long' END AS topic FROM doc)""",
             "c0 AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens) AS tokens, CAST(sum(n_tokens) AS DOUBLE) AS w FROM topical GROUP BY ALL)"]
    for dim in mixing.DIMS:
        power = 0.0 if dim == "topic" else mixing.TEMPER
        views.append(f"t_{dim} AS MATERIALIZED (SELECT {dim}, pow(sum(tokens), {power}) / sum(pow(sum(tokens), {power})) OVER () AS share "
                     f"FROM c0 GROUP BY {dim} HAVING sum(tokens) > 0)")
    k = 0
    for _ in range(mixing.SWEEPS):
        for dim in mixing.DIMS:
            views.append(f"c{k + 1} AS MATERIALIZED (SELECT c.* REPLACE (c.w * coalesce(share * (SELECT sum(tokens) FROM c0) / nullif(have, 0), 0) AS w) "
                         f"FROM c{k} c LEFT JOIN (SELECT {dim}, sum(w) AS have FROM c{k} GROUP BY {dim}) USING ({dim}) LEFT JOIN t_{dim} USING ({dim}))")
            k += 1
    views.append(f"p AS (SELECT source, lang, topic, ratio / max(ratio) OVER () AS p FROM (SELECT *, CASE WHEN tokens > 0 THEN w / tokens ELSE 0 END AS ratio FROM c{k}))")
    return "WITH " + ",\n".join(views) + """
SELECT doc_id, topic, n_tokens, round(p, 6) AS probability,
  n_tokens > 0 AND CAST('0x' || substr(md5('mix:' || doc_id), 1, 8) AS BIGINT) / 4294967296.0 < p AS selected
FROM topical JOIN p USING (source, lang, topic)"""


@query("op10_mixing", _op10_sql())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "selected")


_OP11 = r"""WITH texts AS (SELECT 'd' AS side, doc_id, text FROM documents WHERE doc_id IS NOT NULL UNION ALL SELECT 't', 0, text FROM benchmark),
word AS MATERIALIZED (SELECT side, row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM texts),
feature AS MATERIALIZED (SELECT side, r, array_to_string(w[i:i + n - 1], ' ') AS f, count(*) AS c FROM (
    SELECT side, r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM word, (SELECT unnest([1, 2, 3]) AS n)) GROUP BY ALL),
coded AS MATERIALIZED (SELECT f, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(h) + 1, 2),
    lambda p: CAST(('0x' || h[p:p + 1]) AS BIGINT))), lambda c, b: xor(c >> 8, TABLE[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS INT) AS b
  FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM feature))),
total AS (SELECT sum(c) FILTER (side = 'd') AS s, coalesce(sum(c) FILTER (side = 't'), 0) AS t FROM feature),
gain AS (SELECT b, floor(1000 * ln((coalesce(sum(c) FILTER (side = 't'), 0) + 1) * ((SELECT s FROM total) + 10000)::DOUBLE
    / ((coalesce(sum(c) FILTER (side = 'd'), 0) + 1) * ((SELECT t FROM total) + 10000)::DOUBLE))) AS g FROM feature JOIN coded USING (f) GROUP BY b),
weighed AS (SELECT w.r, w.doc_id, len(w.w) AS n, coalesce(x.c, 0) AS n_features, coalesce(x.g, 0) AS weight FROM word w LEFT JOIN (
    SELECT r, sum(c) AS c, sum(c * g) AS g FROM feature JOIN coded USING (f) JOIN gain USING (b) WHERE side = 'd' GROUP BY r) x USING (r) WHERE side = 'd'),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5e0) / 4294967296e0))) AS score FROM weighed),
placed AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id, n_features, n) AS place FROM scored)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
  CASE WHEN n >= 20 AND place <= (SELECT count(*) FILTER (n >= 20) FROM scored) * 5 // 100 THEN place END AS rank FROM placed""".replace("TABLE", str(resample.crc_table().tolist()))


@query("op11_resample", _OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


@query("op12_align")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align.align(table(spark, sf_dir, "documents"), tokens.default_path("byte_bpe_50k.json"),
                      tokens.default_path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


@query("op13_pack")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(table(spark, sf_dir, "documents"), tokens.default_path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
