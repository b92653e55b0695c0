"""The registered queries of the operators, with production parameters over whole tables, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrail.llm import centroids, chat, decontam, html, langid, lattice, licenses, packing, quality, simhash, toxicity, urls, variants
from tallyrail.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(sql: str | None = None):
    def add(build):
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build
    return add


QUALITY_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
wins AS (
  SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS win FROM (
    SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
often AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM wins),
rep AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (
    SELECT rid, unnest(range(i, i + 5)) AS p FROM often WHERE c >= 2) GROUP BY rid),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(regexp_extract_all(text, '\p{Lu}')) AS BIGINT) AS n_upper
  FROM w LEFT JOIN rep USING (rid)),
f AS (
  SELECT *, CAST((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (n_symbols * 4 > n_words)::INT
    + 8 * (100 * n_dup_lines > 30 * n_lines)::INT + 16 * (n_upper * 2 > word_chars)::INT
    + 32 * (word_chars > 100 * n_words)::INT AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed,
       failed & 23 = 0 AS kept, failed FROM f"""


@query(QUALITY_SQL)
def op7_quality_rules(spark, sf):
    entries = quality.ledger(table(spark, sf, "documents").select("doc_id", "text"))
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                          quality.fails("base-1").alias("base_failed"), (~quality.fails(quality.POLICY)).alias("kept"), "failed")


DECONTAM_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + 9], ' ') AS win FROM (
    SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT rid, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win FROM (
    SELECT rid, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lens WHERE len(ws) >= n)),
hit AS (SELECT rid, dw.n, i, item_id FROM dw JOIN bw USING (win)),
nh AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
ni AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (
    SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nh USING (rid) LEFT JOIN ni USING (rid)"""


@query(DECONTAM_SQL)
def op8_benchmark_decontamination(spark, sf):
    return decontam.report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query()
def op3_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    return langid.classify(docs, langid.learn(docs))


@query()
def op4_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"), tokenizer_path("word_bpe_49k.json"))


@query()
def op9_simhash(spark, sf):
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query()
def op10_lattice_likelihood(spark, sf):
    return lattice.score(table(spark, sf, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query()
def op2_license_scan(spark, sf):
    return licenses.scan(table(spark, sf, "documents")).drop("spans")


@query()
def op6_html_extraction(spark, sf):
    return html.extract(table(spark, sf, "pages"))


# Control strings and escapes as lengths: every control-like string in a text costs one backslash.
CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '[<\[]\\*(?:/?s>|SYS\]|/?INST\]|/?ROLE\])')) + 7
         + CASE role WHEN 'system' THEN 5 WHEN 'user' THEN 6 WHEN 'assistant' THEN 7
           ELSE 13 + length(role) + len(regexp_extract_all(role, '[<\[]\\*(?:/?s>|SYS\]|/?INST\]|/?ROLE\])')) END AS chars
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id"""


@query(CHAT_SQL)
def op1_chat_formatting(spark, sf):
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    ranks = tokenizer_path("byte_bpe_50k.tiktoken")
    return chat.read_back(chat.format_turns(turns, ranks), ranks)


URL_RULES: list[urls.Rule] = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
    ("block", "com", "/de/")]


def _url_sql() -> str:
    """The template tree, one set of common table expressions per level."""
    fits = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    longest = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {fits.format(h=h, p=p)} THEN '{h}{p}'" for _, h, p in longest)
    ruled = " ".join(f"WHEN {fits.format(h=h, p=p)} THEN '{v}'" for v, h, p in longest)
    levels = "".join(f"""
x{d} AS (SELECT *, segments[{d + 1}] AS seg FROM t{d}),
c{d} AS (
  SELECT host, template, seg, sum(n) AS cn, CAST(sum(labelled) AS DOUBLE) AS cl, CAST(sum(blocked) AS DOUBLE) AS cb
  FROM x{d} WHERE seg IS NOT NULL GROUP BY ALL),
p{d} AS (SELECT host, template, count(*) AS kids, sum(cn) AS pn, sum(cl) AS pl, sum(cb) AS pb FROM c{d} GROUP BY ALL),
k{d} AS (
  SELECT host, template, seg, CASE WHEN kids > 1 AND ((cb * pl - pb * cl) * (cb * pl - pb * cl) <= 3.84::DOUBLE * cl * pb * (pl - pb)
    OR (kids > 50 AND cn * 100 < pn * 1)) THEN '*' ELSE seg END AS token FROM c{d} JOIN p{d} USING (host, template)),
t{d + 1} AS (
  SELECT host, path, n, labelled, blocked, segments,
         CASE WHEN seg IS NULL THEN template ELSE template || '/' || token END AS template
  FROM x{d} LEFT JOIN k{d} USING (host, template, seg)),""" for d in range(urls.DEPTH))
    return rf"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{urls.PARTS}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '{urls.PARTS}', 2) AS path FROM pages),
r AS (
  SELECT *, CASE {rule} END AS rule, CASE {ruled} END AS ruled, regexp_replace(path, '[0-9]+', '{{n}}', 'g') AS shape FROM u),
t0 AS (
  SELECT host, shape AS path, count(*) AS n, count(ruled) AS labelled, count(*) FILTER (ruled = 'block') AS blocked, '' AS template,
         CASE WHEN shape = '' THEN [] ELSE list_concat(string_split(regexp_replace(shape, '^/', ''), '/')[1:3], CASE WHEN
           len(string_split(regexp_replace(shape, '^/', ''), '/')) > 3 THEN
           [array_to_string(string_split(regexp_replace(shape, '^/', ''), '/')[4:], '/')] ELSE [] END) END AS segments
  FROM r GROUP BY host, shape),{levels}
counts AS (
  SELECT host, template, regexp_extract(host, '(?:[^.]*\\.)?[^.]*$') AS domain, regexp_extract(host, '[^.]*$') AS top,
         CAST(sum(blocked) AS DOUBLE) AS b, CAST(sum(labelled) AS DOUBLE) AS l FROM t{urls.DEPTH} GROUP BY ALL),
by_host AS (SELECT host, sum(b) AS hb, sum(l) AS hl FROM counts GROUP BY host),
by_domain AS (SELECT domain, sum(b) AS db, sum(l) AS dl FROM counts GROUP BY domain),
by_top AS (SELECT top, sum(b) AS tb, sum(l) AS tl FROM counts GROUP BY top),
q1 AS (
  SELECT *, (tb - db + 4.0::DOUBLE * 0.5::DOUBLE) / (tl - dl + 4.0::DOUBLE) AS of_top
  FROM counts JOIN by_host USING (host) JOIN by_domain USING (domain) JOIN by_top USING (top)),
q2 AS (SELECT *, (db - hb + 4.0::DOUBLE * of_top) / (dl - hl + 4.0::DOUBLE) AS of_domain FROM q1),
q3 AS (SELECT *, (hb - b + 4.0::DOUBLE * of_domain) / (hl - l + 4.0::DOUBLE) AS of_host FROM q2),
pure AS (SELECT host, template, (b + 4.0::DOUBLE * of_host) / (l + 4.0::DOUBLE) AS purity FROM q3)
SELECT page_id, r.host, r.path, rule, coalesce(ruled, CASE WHEN purity >= {urls.REJECT} THEN 'block' ELSE 'allow' END) AS verdict,
       t.template, purity
FROM r JOIN t{urls.DEPTH} t ON t.host = r.host AND t.path = r.shape
JOIN pure ON pure.host = t.host AND pure.template = t.template"""


@query(_url_sql())
def op5_url_filter(spark, sf):
    return urls.judge(table(spark, sf, "pages"), URL_RULES)


def _centroid_sql() -> str:
    """The rounds one after another; a vector's components are rows, so all sums are of whole numbers."""
    def assign(r: int) -> str:
        return f"""
p{r} AS MATERIALIZED (
  SELECT v.rid, c.k, sum((v.x - c.x) * (v.x - c.x)) AS distance FROM v JOIN c{r} c USING (i) GROUP BY ALL),
a{r} AS MATERIALIZED (
  SELECT rid, arg_min(k, (distance, k)) AS k, min(distance) AS distance FROM p{r} GROUP BY rid),"""

    rounds = "".join(assign(r) + f"""
s{r} AS (SELECT a.k, v.i, sum(v.x) AS s, count(*) AS n FROM a{r} a JOIN v USING (rid) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (
  SELECT c.k, c.i, coalesce(CAST((s - ((s % n) + n) % n) // n AS BIGINT), c.x) AS x FROM c{r} c LEFT JOIN s{r} s USING (k, i)),"""
                     for r in range(centroids.ROUNDS))
    last = centroids.ROUNDS
    return f"""
WITH raw AS (
  SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {centroids.SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {centroids.SIZE}),
v AS MATERIALIZED (
  SELECT rid, unnest(range(1, {centroids.SIZE + 1})) AS i,
         unnest(list_transform(embedding, lambda x: CAST(floor({centroids.SCALE} * CAST(x AS DOUBLE)) AS BIGINT))) AS x FROM raw),
f AS (
  SELECT rid, row_number() OVER (ORDER BY sha256('{centroids.SEED}:' || vec_id)) - 1 AS k FROM raw WHERE vec_id IS NOT NULL
  QUALIFY k < {centroids.K}),
c0 AS MATERIALIZED (SELECT k, i, x FROM f JOIN v USING (rid)),{rounds}{assign(last)}
t AS (SELECT k, sum(distance) AS cluster_inertia FROM a{last} GROUP BY k),
h AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{last} GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(cluster_inertia AS BIGINT) AS cluster_inertia,
       CAST((SELECT sum(distance) FROM a{last}) AS BIGINT) AS inertia, centroid_sha256
FROM a{last} JOIN raw USING (rid) JOIN t USING (k) JOIN h USING (k)"""


@query(_centroid_sql())
def op11_centroid_clustering(spark, sf):
    return centroids.cluster(table(spark, sf, "embeddings"))


@query()
def op12_toxicity(spark, sf):
    docs = table(spark, sf, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf, "labels")))


@query()
def op13_spelling_variants(spark, sf):
    return variants.group(table(spark, sf, "documents"))
