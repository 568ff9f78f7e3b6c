"""Queries of host rules, fill-in-the-middle and hard negatives (11 to 13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm import hardnegs, hostrules, ropes
from passagework.llm.common import table


def op11_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and verdict of every document; its ``source`` is its host."""
    judged = hostrules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document rearranged by lines, and of the text restored from it."""
    done = ropes.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = ropes.restore(done.drop("text"))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the vectors whose id is divisible by 100, against all vectors."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardnegs.mine(rows, F.col("id") % 100 == 0, label=label)


_RATE = """CASE WHEN host IS NULL THEN all_{r} / all_n ELSE (f_{r} + all_{r} / all_n * m_{r}) / (n + m_{r}) END AS r_{r}"""
_STRENGTH = """CASE WHEN own_n - own_n2 / own_n > 0 AND s_{r} - own_{r} / own_n * own_{r} - (hosts - 1) * (own_{r} / own_n) * (1 - own_{r} / own_n) > 0
 THEN least(greatest((own_{r} / own_n) * (1 - own_{r} / own_n) / ((s_{r} - own_{r} / own_n * own_{r} - (hosts - 1) * (own_{r} / own_n) * (1 - own_{r} / own_n)) / (own_n - own_n2 / own_n)) - 1, 2.0), 10000.0) ELSE 10000.0 END AS m_{r}"""
_NAMES = ("short", "repeats", "symbols", "lines")

OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, CAST(source AS VARCHAR) AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT row, doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT row, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) > 5),
v AS (SELECT row, i, count(*) OVER (PARTITION BY row, w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) AS c FROM g),
p AS (SELECT row, count(DISTINCT j) AS n FROM (SELECT row, unnest(range(i, i + 5)) AS j FROM v WHERE c > 1) GROUP BY row),
c AS (SELECT w.row, doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
 CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
 CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN p ON w.row = p.row),
f AS (SELECT *, n_words < 10 AS short, 100 * n_repeat_words > 20 * n_words AS repeats, 10 * n_symbols > n_words AS symbols, 10 * n_dup_lines > 3 * n_lines AS lines FROM c),
h AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, {", ".join(f"CAST(count(*) FILTER (WHERE {r}) AS DOUBLE) AS f_{r}" for r in _NAMES)} FROM f GROUP BY host),
a AS (SELECT sum(n) AS all_n, sum(n) FILTER (WHERE host IS NOT NULL) AS own_n, sum(n * n) FILTER (WHERE host IS NOT NULL) AS own_n2, count(host) AS hosts,
 {", ".join(f"sum(f_{r}) AS all_{r}, sum(f_{r}) FILTER (WHERE host IS NOT NULL) AS own_{r}, sum(f_{r} * f_{r} / n) FILTER (WHERE host IS NOT NULL) AS s_{r}" for r in _NAMES)} FROM h),
m AS (SELECT *, {", ".join(_STRENGTH.format(r=r) for r in _NAMES)} FROM a),
r AS (SELECT host, {", ".join(_RATE.format(r=r) for r in _NAMES)} FROM h, m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed,
 NOT (short OR repeats OR greatest({", ".join(f"r_{r}" for r in _NAMES)}) >= 0.8 OR {" OR ".join(f"({r} AND r_{r} >= 0.01)" for r in _NAMES)}) AS kept
FROM f JOIN r ON f.host IS NOT DISTINCT FROM r.host
"""

OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, array_to_string(u[1:lo], '') AS a, array_to_string(u[lo + 1:hi], '') AS b, array_to_string(u[hi + 1:], '') AS c FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""

OP13_SQL = """
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, CAST(list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS DOUBLE[]) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
