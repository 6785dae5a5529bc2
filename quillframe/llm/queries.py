"""Registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm import (
    counts,
    decontamination,
    divergence,
    katz,
    licenses,
    lines,
    minhash,
    packing,
    sharding,
    spelling,
    topk,
    toxicity,
    training_order,
)
from quillframe.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op9_differencing_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    return packing.pack(table(spark, sf_dir, "documents"))


_OP10 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, r, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), bad AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10
), f AS (
  SELECT k.*, bad.key IS NOT NULL AS gone FROM k LEFT JOIN bad USING (key)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines,
  CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY r
"""


@query("op10_line_dedup", _OP10)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that ten documents share leave every document."""
    out = lines.drop_shared_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def _remainder(of: int):
    """crc32 of the id as text, modulo ``of``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


@query("op2_differencing_shards")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes, copies together."""
    out = sharding.shard(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


_OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1]
    ELSE unnest(list_transform(range(1, greatest(len(ws), 1)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS g
  FROM w WHERE len(ws) > 1
  UNION SELECT doc_id, ws[1] FROM w WHERE len(ws) = 1
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
  WHERE 100 * c >= 80 * (a.n + b.n - c)
), e AS (
  SELECT x, y FROM l UNION SELECT y, x FROM l
), r(node, near) AS (
  SELECT x, y FROM e UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.near
), c AS (
  SELECT node, min(near) AS comp FROM r GROUP BY node
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(comp, w.doc_id)) AS component_id,
  w.doc_id <= coalesce(comp, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = w.doc_id
"""


@query("op4_superminhash_groups", _OP4)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that share four fifths of their two-word shingles."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=2)


@query("op5_noisy_or_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from four fifths of the labels."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), _remainder(5) != 0)
    return toxicity.score(docs, model).select(
        "doc_id",
        (_remainder(5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_sentences",
        F.size("offending").cast("long").alias("n_offending"),
    )


_OP7 = """
WITH v AS (
  SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(floor(1024 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x,
    len(embedding) AS dim
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.i = c.i AND q.dim = c.dim AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0 GROUP BY 1, 2
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM d
) WHERE rank <= 10
"""


@query("op7_no_random_access_topk", _OP7)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best inner products of each hundredth vector with all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


_OP8 = r"""
WITH d AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents
  UNION ALL SELECT 'i', item_id, text FROM benchmark
), w AS (
  SELECT kind, id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS ws FROM d
), s AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(ws) >= 5
    THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ') || ' |' || len(ws)] ELSE [] END) AS g FROM w
), n AS (
  SELECT id, count(*) AS n FROM s WHERE kind = 'i' GROUP BY id
), c AS (
  SELECT a.id AS doc_id, b.id AS item_id, count(*) / any_value(n.n) AS share
  FROM s a JOIN s b ON a.kind = 'd' AND b.kind = 'i' AND a.g = b.g JOIN n ON n.id = b.id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * any_value(n.n)
), f AS (
  SELECT doc_id, count(*) AS n_items, array_to_string(list(item_id ORDER BY item_id), ',') AS item_ids,
    max(share) AS containment FROM c GROUP BY doc_id
)
SELECT doc_id, coalesce(n_items, 0) AS n_items, coalesce(item_ids, '') AS item_ids,
  round(coalesce(containment, 0), 6) AS containment, n_items IS NOT NULL AS contaminated
FROM documents LEFT JOIN f USING (doc_id)
"""


@query("op8_sized_minhash_containment", _OP8)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items inside documents, four fifths of their five-word shingles."""
    out = decontamination.find_items(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return out.select(
        "doc_id",
        F.size("items").cast("long").alias("n_items"),
        F.array_join("items", ",").alias("item_ids"),
        F.round("containment", 6).alias("containment"),
        "contaminated",
    )


@query("op1_feistel_order")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as sequences of 2048 ids in training order, read back from their shards."""
    path = scratch_path(spark, "order")
    training_order.materialise(table(spark, sf_dir, "documents"), path)
    return training_order.read_slots(spark, path).drop("ids")


@query("op6_separator_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document, found in flat files of all documents' ids."""
    path = scratch_path(spark, "flat")
    counts.write_flat(table(spark, sf_dir, "documents"), path)
    part = F.regexp_extract("file", r"part-(\d+)", 1).cast("int")
    return counts.scan_flat(spark, path).withColumn("file", part)


@query("op3_katz_backoff")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a bigram model of nine tenths of them."""
    out = katz.score(table(spark, sf_dir, "documents"), _remainder(10) != 0)
    return out.select("*", (_remainder(10) == 0).alias("held_out")).drop("learned")


def _templates_sql() -> str:
    """Rows of the templates: number, label, base, least share, words, words in keys, place, word, in a key, first key."""
    rows = []
    for i, t in enumerate(licenses.TEMPLATES):
        own, keys = licenses.words_and_keys(t)
        must = {j for at, n in keys for j in range(at, at + n)}
        rows += [
            f"({i}, '{t.label}', {t.base}, {t.least}, {len(own)}, {len(must)}, {j}, '{w}', {int(j in must)}, {min(must)})"
            for j, w in enumerate(own)
        ]
    return ", ".join(rows)


_OP11 = rf"""
WITH t(num, label, base, least, size, must, off, word, in_key, first_key) AS (VALUES {_templates_sql()}),
d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), w AS (
  SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM d
), m AS (
  SELECT r, label, base, w.i - t.off AS start, w.i - t.off + any_value(first_key) AS key,
    count(*) / any_value(size) AS share
  FROM w JOIN t USING (word) GROUP BY r, num, label, base, w.i - t.off
  HAVING sum(in_key) = any_value(must) AND share >= any_value(least)
)
SELECT any_value(doc_id) AS doc_id, CAST(any_value(len(ws)) AS BIGINT) AS n_words,
  count(*) FILTER (base) AS n_base, CAST(min(key) FILTER (base) AS BIGINT) AS first_word,
  CAST(max(key) FILTER (base) AS BIGINT) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
  round(coalesce(max(share), 0), 9) AS score
FROM d LEFT JOIN m USING (r) GROUP BY r
"""


@query("op11_rare_word_licenses", _OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that documents name or quote."""
    out = licenses.digest(licenses.find_licenses(table(spark, sf_dir, "documents")))
    return out.withColumn("score", F.round("score", 9))


_OP13 = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents
), w AS (
  SELECT lang, source, r, unnest(ws) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), l AS (
  SELECT lang, sum(lang_n) AS lang_total, count(*) AS v FROM k GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), h AS (
  SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term
), c AS (
  SELECT g.lang, g.source, k.term, k.lang_n, coalesce(h.n, 0) AS n
  FROM g JOIN k ON k.lang = g.lang LEFT JOIN h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term
), s AS (
  SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source
), p AS (
  SELECT c.lang, c.source, c.term, c.n,
    CAST(1 + CAST(1000000000 AS HUGEINT) * (c.n + 2) // (s.total + 2 * l.v) AS BIGINT) AS p,
    CAST(1 + CAST(1000000000 AS HUGEINT) * (c.lang_n + 2) // (l.lang_total + 2 * l.v) AS BIGINT) AS q
  FROM c JOIN s USING (lang, source) JOIN l USING (lang)
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), o AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank
FROM r WHERE part = 'pair' OR rank <= 10
"""


@query("op13_source_divergence", _OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of the sources of each language and the terms that set each apart."""
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op12_partenum_spelling")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, some with a letter taken out, and the frequent words they are variants of."""
    counted = spelling.count_words(table(spark, sf_dir, "documents"), drop_one_in=31)
    return spelling.variants(counted)
