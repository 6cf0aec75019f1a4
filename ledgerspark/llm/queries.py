"""The registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, divergence, fertility, line_edit, mixing, norm_search, quality, simhash, spans, token_orc, toxicity, vector_codes, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.rate(table(spark, sf_dir, "documents"))


def op4_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedup(table(spark, sf_dir, "documents"))


def op5_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.token_report(table(spark, sf_dir, "documents"))


def op6_line_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_edit.near_lines(table(spark, sf_dir, "documents")).drop("row")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_warc(table(spark, sf_dir, "pages"))
    return warc.read_warc(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("skey", "row")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_norm_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_search.search(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_quality, op2_simhash, op3_fertility, op4_spans, op5_token_orc, op6_line_edit, op7_warc, op8_toxicity, op9_decontam, op10_entropy_mix, op11_vector_codes, op12_divergence, op13_norm_search)}

_WHOLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Codes by whole distances to all entries."""
    width, ctes = "(len(v) // %d)" % parts, []
    ctes.append(f"k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {_WHOLE})")
    ctes.append(f"x AS (SELECT vec_id, label, p, list_slice(v, p * {width} + 1, (p + 1) * {width}) AS c FROM k, range({parts}) r(p))")
    ctes.append(f"b0 AS (SELECT p, e, c FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT {entries}) USING (vec_id))")
    for r in range(rounds + 1):
        ctes.append(f"d{r} AS (SELECT vec_id, label, p, e, x.c AS c, list_sum(list_transform(list_zip(x.c, b{r}.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN b{r} USING (p))")
        ctes.append(f"a{r} AS (SELECT vec_id, label, p, c, arg_min(e, d * {entries} + e) AS e, min(d) AS d FROM d{r} GROUP BY 1, 2, 3, 4)")
        if r < rounds:
            ctes.append(f"u{r} AS (SELECT p, e, list(floor(s / n)::BIGINT ORDER BY i) AS c FROM (SELECT p, e, i, sum(c[i])::DOUBLE AS s, count(*) AS n FROM a{r}, range(1, 1000) t(i) WHERE i <= len(c) GROUP BY 1, 2, 3) GROUP BY 1, 2)")
            ctes.append(f"b{r + 1} AS (SELECT p, e, coalesce(u{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN u{r} USING (p, e))")
    ctes.append(f"o AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY 1, 2)")
    digest = f"(SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{rounds})"
    return f"WITH {', '.join(ctes)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, {digest} AS codebooks_sha256 FROM o"


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_DIVERGENCE = rf"""WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_FOLDED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT doc, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT doc) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, source, t.term, count(*) AS n FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY 1, 2, 3),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS n FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (s.n + 5 * v.v))::BIGINT AS p, (1 + (1000000000::HUGEINT * (k.n + 5)) // (v.n + 5 * v.v))::BIGINT AS q
 FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang JOIN s ON g.lang = s.lang AND g.source = s.source LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
 UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r) WHERE part = 'pair' OR rank <= 50"""

_SEARCH = f"""WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings WHERE {_WHOLE}),
s AS (SELECT q.r, q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x)::BIGINT AS score FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.r <> v.r)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 20"""

#: Oracles in DuckDB SQL, for those queries that SQL can express.
ORACLES: dict[str, str] = {"op11_vector_codes": _codes_sql(), "op12_divergence": _DIVERGENCE, "op13_norm_search": _SEARCH}
