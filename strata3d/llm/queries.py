"""One query per operator over the given tables, with production parameters, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, hostrules, language, linetemplates, maintext, parityjoin, pieces,
               quality, simhash, substrings, toxicity, turntrie, whitening)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Vocabulary file of the encoder; a deployment sets its own path.
VOCABULARY = os.environ.get("PIECES_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(parts: int) -> F.Column:
    """Remainder of the CRC-32 of the id's text; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sample = quality.sampled(table(spark, sf_dir, "labels"), "quality", quality.SAMPLE,
                             fold(4) != 2)
    scored = quality.score(docs, quality.fit(docs, sample))
    return scored.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"),
                         "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs, fold(5) != 0))
    return found.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"),
                        "lang_pred", "score", "ambiguous")


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, n) for n in ("documents", "labels"))
    model = toxicity.train(docs, labels, "toxic", fold(4) != 2)
    return toxicity.severity(docs, model).select(
        "doc_id", "severity", "p_toxic", (F.col("p_toxic") >= 0.5).alias("toxic"))


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


ORACLE["op4_host_rules"] = r"""
WITH w AS (SELECT doc_id, lower(source) AS host, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, ws[i:i + 4] AS k FROM w, unnest(range(1, len(ws) - 3)) AS r(i)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c
    FROM win) WHERE c > 1),
rep AS (SELECT doc_id, sum(least(5, g)) AS n FROM (SELECT doc_id,
    i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -10) AS g FROM dup) GROUP BY 1),
m AS (SELECT doc_id, host, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(t, chr(10)),
        lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT host, count(*) AS n, sum(base_failed::INT) AS f FROM b WHERE host IS NOT NULL
    GROUP BY 1),
p AS (SELECT mu, CASE WHEN v > 1e-12 THEN greatest(mu * (1 - mu) / v - 1, 0) END AS s FROM (
    SELECT any_value(mu) AS mu, sum(n * (f / n - mu) * (f / n - mu)) / sum(n) AS v
    FROM h, (SELECT sum(f) / sum(n) AS mu FROM h))),
r AS (SELECT host, coalesce((f + s * mu) / (n + s), mu) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    round(rate, 6) AS host_rate, NOT base_failed AND NOT coalesce(rate > 0.5, false) AS kept
FROM b LEFT JOIN r USING (host)
"""


@query
def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", F.round("host_rate", 6).alias("host_rate"), "kept")


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = linetemplates.cleaned(docs, "rest", "gone")
    return out.select("doc_id", F.coalesce(F.size("gone"), F.lit(0)).alias("n_dropped"),
                      F.array_sort("gone").alias("dropped_lines"), F.col("rest").alias("text"))


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"),
                                      table(spark, sf_dir, "benchmark"))


@query
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return maintext.extract(pages, maintext.fit(pages, table(spark, sf_dir, "documents")))


@query
def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"), pieces.read_model(VOCABULARY))


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_cut", (F.col("n_cut") > 0).alias("has_repeat"), "cut_spans",
                      "text")


@query
def op11_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parityjoin.joined(table(spark, sf_dir, "documents"))


ORACLE["op11_parity_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
    FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4
    THEN [hash(array_to_string(ws, ' '))] ELSE list_distinct(list_transform(
    range(1, len(ws) - 2), lambda i: hash(array_to_string(ws[i:i + 3], ' ')))) END AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n, list_sort(sh) AS sh FROM s),
g AS (SELECT min(doc_id) AS node, sh, any_value(n) AS n FROM n WHERE n > 0 GROUP BY sh),
e AS (SELECT node, n, unnest(sh) AS h FROM g),
p AS (SELECT x.node AS a, y.node AS b FROM e AS x JOIN e AS y ON x.h = y.h AND x.node < y.node
    AND 100 * x.n >= 85 * y.n AND 100 * y.n >= 85 * x.n
    GROUP BY x.node, y.node, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT node, node AS top FROM g UNION SELECT l.b, r.top FROM r JOIN l ON l.a = r.node),
c AS (SELECT node, min(top) AS top FROM r GROUP BY node)
SELECT n.doc_id, n.n AS n_shingles, CASE WHEN n.n = 0 THEN n.doc_id ELSE c.top END AS component_id
FROM n LEFT JOIN g ON n.sh = g.sh LEFT JOIN c ON c.node = g.node
"""


@query
def op12_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turntrie.nodes(turntrie.rebuilt(table(spark, sf_dir, "conversations")))


ORACLE["op12_turn_trie"] = r"""
WITH t AS (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '')
      || coalesce(text, '')) AS k,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
    FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({'k': k, 'w': words} ORDER BY turn NULLS FIRST, k) AS ts FROM t GROUP BY 1),
crc AS (SELECT conv_id, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(
      range(1, length(CAST(conv_id AS VARCHAR)) + 1),
      lambda i: ascii(CAST(conv_id AS VARCHAR)[i])::UBIGINT)),
    lambda c, x: list_reduce(list_prepend(xor(c, x), [0::UBIGINT for j in range(8)]),
      lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)) AS raw,
    xor(raw, 4294967295::UBIGINT) % 4 AS h FROM (SELECT DISTINCT conv_id FROM o)),
h AS (SELECT c.conv_id, c.ts, coalesce(b.ts, []) AS head, crc.h FROM o AS c
    LEFT JOIN o AS b ON b.conv_id = c.conv_id - c.conv_id % 20
    JOIN crc ON crc.conv_id = c.conv_id),
v AS (SELECT conv_id, list_concat(head[1:h], ts[h + 1:]) AS ts FROM h),
m AS (SELECT conv_id, len(ts) AS n, d, list_transform(ts[1:d], lambda x: x.k) AS path,
      CASE WHEN d > 0 THEN ts[d].w ELSE 0 END AS w
    FROM v, unnest(range(0, len(ts) + 1)) AS r(d)),
a AS (SELECT path, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    any_value(w) AS w, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
      FILTER (n = d), '')) AS ends_sha256 FROM m GROUP BY path),
k AS (SELECT path[1:len(path) - 1] AS path, count(*) AS n FROM a WHERE depth > 0 GROUP BY 1),
f AS (SELECT a.*, coalesce(k.n, 0) AS n_children FROM a LEFT JOIN k USING (path)),
u AS (SELECT path[1:i] AS path, sum(CAST(n_children = 0 AS BIGINT)) AS n_leaves,
    sum((n_convs - 1) * w) AS saved FROM f, unnest(range(0, depth + 1)) AS r(i) GROUP BY 1)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children,
    CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN u USING (path)
LEFT JOIN f AS p ON f.depth > 0 AND p.path = f.path[1:f.depth - 1]
"""


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))
