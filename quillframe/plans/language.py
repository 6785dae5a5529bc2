"""Queries for the language model, correction and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.functions.arrays import hold
from quillframe.functions.text import edit_distance, words
from quillframe.operators import correction as co
from quillframe.operators import evaluation as ev
from quillframe.operators import ngrams as ng
from quillframe.operators.fuzzy_index import FuzzyIndex
from quillframe.operators.kept_counts import KeptCounts
from quillframe.operators.ordering import exceeds
from quillframe.operators.packed_counts import buckets_for
from quillframe.plans import views as v
from quillframe.plans.registry import query, rounded
from quillframe.session import scratch_path, stable
from quillframe.sources import writers

_KEPT_BYTES = 4 << 20  # of the table of documents for each bucket of kept counts

# DuckDB's edit distance counts bytes: the accented letters of the texts are exchanged for single
# bytes first, which leaves distances between characters.
_ACCENTED = "éóèñçêüäöíßÉÈÑÓÇÜÄÊÍÖ"
_CODES = " || ".join(f"chr({i})" for i in range(1, len(_ACCENTED) + 1))


def _plain(e: str) -> str:
    return f"translate({e}, '{_ACCENTED}', {_CODES})"


# --- n-grams --------------------------------------------------------------------------------------

_COUNT_SQL = (
    v.SQL_TOKENS
    + """,
    running AS (SELECT w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3
      FROM tokens WINDOW o AS (ORDER BY doc_id, pos)),
    uni AS (SELECT w1, count(*) AS n FROM running GROUP BY w1),
    bi AS (SELECT w1, w2, count(*) AS n FROM running WHERE w2 IS NOT NULL GROUP BY ALL),
    tri AS (SELECT w1, w2, w3, count(*) AS n FROM running WHERE w3 IS NOT NULL GROUP BY ALL),
    size AS (SELECT count(*) AS v, sum(n)::BIGINT AS t FROM uni)"""
)


def _model(spark, sf, orders=3):
    return ng.LanguageModel.build(v.segments(spark, sf), ["doc_id"], orders)


@query("l1_unigram_counts", f"WITH {_COUNT_SQL} SELECT w1, n FROM uni")
def l1(spark, sf):
    return ng.unigram_counts(v.segments(spark, sf))


@query("l1_totals", f"WITH {_COUNT_SQL} SELECT v AS vocabulary, t AS tokens FROM size")
def l1_totals(spark, sf):
    return ng.totals(ng.unigram_counts(v.segments(spark, sf)))


@query("l2_bigram_counts", f"WITH {_COUNT_SQL} SELECT w1, w2, n FROM bi")
def l2(spark, sf):
    return ng.ngram_counts(v.segments(spark, sf), ["doc_id"], 2)


@query("l3_trigram_counts", f"WITH {_COUNT_SQL} SELECT w1, w2, w3, n FROM tri")
def l3(spark, sf):
    return ng.ngram_counts(v.segments(spark, sf), ["doc_id"], 3)


@query("l3_incremental_trigrams", f"WITH {_COUNT_SQL} SELECT w1, w2, w3, n FROM tri")
def l3_kept(spark, sf):
    """Trigrams of documents that come by language, one language at a time, with a compaction between."""
    docs = v.table(spark, sf, "documents")
    kept = KeptCounts(spark, scratch_path(spark, "counts"), ["doc_id"], 3, buckets=buckets_for(docs, _KEPT_BYTES))
    if exceeds(docs, ["doc_id"], 1):
        segments = v.segments(spark, sf).join(docs.select("doc_id", "lang"), "doc_id")
    else:  # the language of a text's id is that of its own row
        segments = v.segments(spark, sf, "lang").where(F.col("doc_id").isNotNull())
    segments = stable(segments, "segments")
    for lang in ("fr", "de", "es"):
        kept.add(lang, segments.where(F.col("lang") == lang))
    kept.compact()
    kept.add("rest", segments.where("lang is null or lang not in ('fr', 'de', 'es')"))
    return kept.counts(3)


_ASKED_SQL = """
    asked AS (SELECT conv_id, turn, u.pos - 1 AS pos, t[u.pos] AS true_text FROM (
        SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '{space}+'), lambda w: w <> '') AS t
        FROM conversations), LATERAL (SELECT unnest(range(1, len(t) + 1)) AS pos) u),
    garbled AS (SELECT *, CASE (conv_id + turn + pos) % 4 WHEN 0 THEN true_text
        WHEN 1 THEN left(true_text, length(true_text) - 1) WHEN 2 THEN true_text || 'e'
        ELSE translate(true_text, 'aeiou', 'eioua') END AS word FROM asked)""".replace("{space}", v.SPACE)


def _garbled(spark, sf):
    """Words of the conversations and what a recogniser made of them."""
    turns = hold(v.table(spark, sf, "conversations"), "tokens", words(F.col("text")))
    rows = turns.select("conv_id", "turn", F.posexplode("tokens").alias("pos", "true_text"))
    key = F.col("conv_id") + F.col("turn") + F.col("pos")
    return rows.select(
        "conv_id",
        "turn",
        F.col("pos").cast("bigint").alias("pos"),
        "true_text",
        v.garbled(F.col("true_text"), key).alias("word"),
    )


@query(
    "l4_word_scores",
    f"""WITH {_COUNT_SQL}, {_ASKED_SQL}
    SELECT conv_id, turn, pos, word, round(ln((coalesce(n, 0) + 1) / (t + v)), 9) AS score
    FROM garbled LEFT JOIN uni ON word = w1, size""",
)
def l4(spark, sf):
    out = ng.score_words(_garbled(spark, sf).drop("true_text"), "word", _model(spark, sf, 1))
    return out.withColumn("score", rounded("score", 9))


@query(
    "l5_sequence_scores",
    f"""WITH {_COUNT_SQL}, {_ASKED_SQL},
    ctx AS (SELECT conv_id, turn, pos, word AS w, lag(word, 1) OVER o AS p1, lag(word, 2) OVER o AS p2
      FROM garbled WINDOW o AS (PARTITION BY conv_id, turn ORDER BY pos)),
    found AS (SELECT c.*, tri.n AS c3, bp.n AS cp, b.n AS c2, u.n AS c1p, x.n AS c1 FROM ctx c
      LEFT JOIN tri ON tri.w1 = p2 AND tri.w2 = p1 AND tri.w3 = w
      LEFT JOIN bi bp ON bp.w1 = p2 AND bp.w2 = p1 LEFT JOIN bi b ON b.w1 = p1 AND b.w2 = w
      LEFT JOIN uni u ON u.w1 = p1 LEFT JOIN uni x ON x.w1 = w)
    SELECT conv_id, turn, round(sum(ln(CASE WHEN p1 IS NULL THEN (coalesce(c1, 0) + 1) / (t + v)
      WHEN p2 IS NULL THEN CASE WHEN c2 IS NOT NULL THEN (c2 + 1) / (c1p + v) ELSE 1 / (coalesce(c1p, 1) + v) END
      WHEN c3 IS NOT NULL THEN (c3 + 1) / (coalesce(cp, 1) + v)
      WHEN c2 IS NOT NULL THEN (c2 + 1) / (coalesce(c1p, 1) + v)
      ELSE (coalesce(c1, 0) + 1) / (t + v) END)), 6) AS score
    FROM found, size GROUP BY conv_id, turn
    UNION ALL SELECT conv_id, turn, 0.0 FROM conversations
      WHERE (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM asked)""",
)
def l5(spark, sf):
    """Turns of the conversations, as recognised, under the model of the documents."""
    text = v.table(spark, sf, "conversations").select("conv_id", "turn", words(F.col("text")).alias("t"))
    sequences = text.select(
        "conv_id",
        "turn",
        F.transform("t", lambda w, i: v.garbled(w, F.col("conv_id") + F.col("turn") + i)).alias("tokens"),
    )
    out = ng.score_sequences(sequences, ["conv_id", "turn"], _model(spark, sf))
    return out.withColumn("score", rounded("score"))


@query(
    "l6_edit_distance",
    f"WITH {v.SQL_PAIRS} SELECT doc_id, pos, levenshtein({_plain('predicted_text')}, {_plain('true_text')})::INTEGER "
    "AS dist FROM pairs",
)
def l6(spark, sf):
    dist = edit_distance(F.col("predicted_text"), F.col("true_text"))
    return v.pairs(spark, sf).select("doc_id", F.col("pos").cast("bigint").alias("pos"), dist.alias("dist"))


# Two edits leave at least one of three pieces of the known word whole, moved by at most two places
# in the other word. So pairs meet on a piece, and on a few letters' counts, of which an edit changes at most two
# by one, before the distance is taken.
_LETTERS = "eaiontrs"
_letters_near = (
    "(" + " + ".join(f"abs(u.{c}_ - k.{c}_)" for c in _LETTERS) + ") <= 4"
)


def _letters(e: str) -> str:
    return ", ".join(f"(length({e}) - length(replace({e}, '{c}', '')))::TINYINT AS {c}_" for c in _LETTERS)


_CANDIDATE_SQL = f"""WITH {_COUNT_SQL}, {_ASKED_SQL},
    unknown AS (SELECT DISTINCT word FROM garbled WHERE word NOT IN (SELECT w1 FROM uni)),
    u AS (SELECT word, {_plain('word')} AS p, length(word) AS len, {_letters('word')} FROM unknown),
    k AS (SELECT w1, n, {_plain('w1')} AS p, length(w1) AS len, {_letters('w1')} FROM uni),
    three AS (SELECT unnest([0, 1, 2]) AS piece),
    known AS (SELECT k.*, piece, substr(p, (len * piece // 3 + 1)::BIGINT,
        (len * (piece + 1) // 3 - len * piece // 3)::BIGINT) AS part FROM k, three),
    sized AS (SELECT u.*, unnest(range(greatest(len - 2, 0), len + 3)) AS other FROM u),
    moved AS (SELECT sized.*, piece, unnest([-2, -1, 0, 1, 2]) AS shift FROM sized, three),
    spelled AS (SELECT DISTINCT word, p, other, piece, {', '.join(c + '_' for c in _LETTERS)},
        substr(p, (other * piece // 3 + 1 + shift)::BIGINT, (other * (piece + 1) // 3 - other * piece // 3)::BIGINT) AS part
      FROM moved WHERE other * piece // 3 + shift >= 0),
    met AS (SELECT DISTINCT u.word, k.w1, u.p AS a, k.p AS b, k.n FROM spelled u JOIN known k
      ON u.other = k.len AND u.piece = k.piece AND u.part = k.part AND {_letters_near}),
    pair AS (SELECT word, w1 AS candidate, n, levenshtein(a, b)::INTEGER AS dist FROM met WHERE levenshtein(a, b) <= 2),
    scored AS (SELECT *, ln((n + 1) / (t + v)) - 2.0 * dist AS score FROM pair, size),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY score DESC, dist, candidate) AS rank FROM scored)"""


@query("l7_fuzzy_candidates", _CANDIDATE_SQL + "SELECT word, candidate, dist FROM pair")
def l7(spark, sf):
    model = _model(spark, sf, 1)
    return co.candidates(co.unknown_words(_garbled(spark, sf), model), model.unigrams)


@query("l7_kept_index_candidates", _CANDIDATE_SQL + "SELECT word, candidate, dist FROM pair")
def l7_kept(spark, sf):
    """The same pairs from a kept index: English words first, the others as an increment, then compacted."""
    model = _model(spark, sf, 1)
    docs = v.table(spark, sf, "documents").where("lang = 'en'").select("doc_id", words(F.col("text")).alias("tokens"))
    index = FuzzyIndex.create(ng.unigram_counts(docs).select("w1"), scratch_path(spark, "fuzzy"))
    index.add(model.unigrams)
    return index.compact().search(co.unknown_words(_garbled(spark, sf), model))


_CORRECT_SQL = (
    _CANDIDATE_SQL
    + """, corrected AS (SELECT g.*, coalesce(r.candidate, g.word) AS corrected
      FROM garbled g LEFT JOIN ranked r ON g.word = r.word AND r.rank = 1)"""
)


@query("l8_best_correction", _CORRECT_SQL + "SELECT conv_id, turn, pos, word, corrected FROM corrected")
def l8(spark, sf):
    return co.correct(_garbled(spark, sf).drop("true_text"), _model(spark, sf, 1))


@query(
    "l9_top_corrections",
    _CANDIDATE_SQL
    + "SELECT word, candidate, dist, rank::INTEGER AS rank, round(score, 9) AS score FROM ranked WHERE rank <= 5",
)
def l9(spark, sf):
    out = co.top_corrections(_garbled(spark, sf), _model(spark, sf, 1))
    return out.withColumn("score", rounded("score", 9))


def _accuracy_sql(word: str) -> str:
    return (
        f"1.0 - levenshtein({_plain(word)}, {_plain('true_text')})::DOUBLE / greatest(1, length(true_text))"
    )


@query(
    "flagship_correction_gain",
    _CORRECT_SQL
    + f"""SELECT length(true_text)::INTEGER AS word_length, count(*) AS n,
      round(avg((word = true_text)::INTEGER), 9) AS accuracy_before,
      round(avg((corrected = true_text)::INTEGER), 9) AS accuracy_after,
      round(avg({_accuracy_sql('word')}), 9) AS characters_before,
      round(avg({_accuracy_sql('corrected')}), 9) AS characters_after
    FROM corrected GROUP BY length(true_text)""",
)
def flagship(spark, sf):
    """Word and character accuracy by word length, before and after correction."""
    fixed = co.correct(_garbled(spark, sf), _model(spark, sf, 1))
    true = F.col("true_text")
    return (
        fixed.groupBy(F.length("true_text").alias("word_length"))
        .agg(
            F.count("*").alias("n"),
            *[
                rounded(F.avg(e), 9).alias(name)
                for name, e in (
                    ("accuracy_before", ev.is_correct(true, F.col("word")).cast("int")),
                    ("accuracy_after", ev.is_correct(true, F.col("corrected")).cast("int")),
                    ("characters_before", 1.0 - ev.error_rate(true, F.col("word"))),
                    ("characters_after", 1.0 - ev.error_rate(true, F.col("corrected"))),
                )
            ],
        )
        .orderBy("word_length")
    )


# --- evaluation -------------------------------------------------------------------------------------

_ANALYSIS_SQL = f"""WITH {v.SQL_PAIRS},
    dist AS (SELECT *, levenshtein({_plain('predicted_text')}, {_plain('true_text')})::INTEGER AS d FROM pairs),
    analysis AS (SELECT doc_id, pos, true_text, predicted_text, trim(predicted_text) = trim(true_text) AS is_correct,
        length(true_text)::INTEGER AS word_length, d AS character_errors,
        1.0 - d::DOUBLE / greatest(1, length(true_text)) AS exact,
        CASE WHEN predicted_text = true_text THEN 'None'
          WHEN length(predicted_text) < length(true_text) THEN 'Under-prediction'
          WHEN length(predicted_text) > length(true_text) THEN 'Over-prediction'
          ELSE 'Substitution' END AS error_type,
        (length(predicted_text) - length(true_text))::INTEGER AS length_difference FROM dist),
    rows AS (SELECT *, round(exact, 4) AS acc FROM analysis)
    """


def _analysis(spark, sf):
    return ev.analysis(v.pairs(spark, sf))


@query("e1_character_error_rate", _ANALYSIS_SQL + "SELECT round(avg(1.0 - exact), 9) AS cer FROM rows")
def e1(spark, sf):
    return ev.metrics(v.pairs(spark, sf)).select(rounded("cer", 9).alias("cer"))


@query(
    "e2_word_accuracy",
    _ANALYSIS_SQL
    + """SELECT round(avg(is_correct::INTEGER), 9) AS word_accuracy,
      round(1.0 - avg(is_correct::INTEGER), 9) AS sample_error_rate FROM rows""",
)
def e2(spark, sf):
    return ev.metrics(v.pairs(spark, sf)).select(
        rounded("word_accuracy", 9).alias("word_accuracy"),
        rounded("sample_error_rate", 9).alias("sample_error_rate"),
    )


@query(
    "e3_sample_analysis",
    _ANALYSIS_SQL
    + """SELECT doc_id, pos, is_correct, word_length, character_errors, round(exact, 9) + 0.0 AS character_accuracy_exact,
      acc + 0.0 AS character_accuracy, length_difference FROM rows""",
)
def e3(spark, sf):
    return _analysis(spark, sf).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), "is_correct", "word_length", "character_errors",
        rounded("character_accuracy_exact", 9).alias("character_accuracy_exact"),
        (F.col("character_accuracy") + 0.0).alias("character_accuracy"), "length_difference",
    )


@query("e4_error_class", _ANALYSIS_SQL + "SELECT doc_id, pos, error_type FROM rows")
def e4(spark, sf):
    return _analysis(spark, sf).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "error_type")


@query(
    "e5_totals",
    _ANALYSIS_SQL
    + """SELECT count(*) AS samples, sum(is_correct::INTEGER)::BIGINT AS correct,
      round(avg(is_correct::INTEGER), 9) AS accuracy FROM rows""",
)
def e5(spark, sf):
    return ev.overall(_analysis(spark, sf)).withColumn("accuracy", rounded("accuracy", 9))


@query(
    "e6_by_word_length",
    _ANALYSIS_SQL
    + """SELECT word_length, count(*) AS n, sum(is_correct::INTEGER)::BIGINT AS correct,
      round(avg(is_correct::INTEGER), 9) AS accuracy, round(avg(acc), 9) AS mean_character_accuracy
    FROM rows GROUP BY word_length""",
)
def e6(spark, sf):
    out = ev.by_length(_analysis(spark, sf))
    return out.withColumn("accuracy", rounded("accuracy", 9)).withColumn(
        "mean_character_accuracy", rounded("mean_character_accuracy", 9)
    )


@query(
    "e7_error_classes",
    _ANALYSIS_SQL + "SELECT error_type, count(*) AS n FROM rows WHERE NOT is_correct GROUP BY error_type",
)
def e7(spark, sf):
    return ev.error_class_counts(_analysis(spark, sf))


@query(
    "e8_error_prone_lengths",
    _ANALYSIS_SQL
    + """SELECT word_length, count(*) AS n FROM rows WHERE NOT is_correct GROUP BY word_length
    ORDER BY n DESC, word_length LIMIT 10""",
)
def e8(spark, sf):
    return ev.error_prone_lengths(_analysis(spark, sf))


@query(
    "e9_accuracy_spread",
    _ANALYSIS_SQL
    + """SELECT round(avg(acc), 9) AS mean_accuracy, min(acc) AS min_accuracy, max(acc) AS max_accuracy FROM rows""",
)
def e9(spark, sf):
    return ev.accuracy_spread(_analysis(spark, sf)).withColumn("mean_accuracy", rounded("mean_accuracy", 9))


@query(
    "e10_worst_samples",
    _ANALYSIS_SQL
    + """SELECT doc_id, pos, true_text, predicted_text, acc AS character_accuracy FROM rows
    ORDER BY acc, doc_id, pos LIMIT 5""",
)
def e10(spark, sf):
    return ev.worst(_analysis(spark, sf), ["doc_id", "pos"]).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), "true_text", "predicted_text", "character_accuracy"
    )


@query(
    "e11_first_examples",
    _ANALYSIS_SQL
    + """SELECT is_correct, example::INTEGER AS example, doc_id, pos, true_text, predicted_text FROM (SELECT *, row_number() OVER
      (PARTITION BY is_correct ORDER BY doc_id, pos) AS example FROM rows) WHERE example <= 3""",
)
def e11(spark, sf):
    rows = _analysis(spark, sf).select("doc_id", "pos", "true_text", "predicted_text", "is_correct")
    return ev.first_examples(rows, ["doc_id", "pos"]).select(
        "is_correct", "example", "doc_id", F.col("pos").cast("bigint").alias("pos"), "true_text", "predicted_text"
    )


@query(
    "k2_summary_report",
    _ANALYSIS_SQL
    + """, wrong AS (SELECT * FROM rows WHERE NOT is_correct),
    totals AS (SELECT count(*)::DOUBLE AS samples, sum(is_correct::INTEGER)::DOUBLE AS correct,
      avg(is_correct::INTEGER) AS accuracy FROM rows),
    lengths AS (SELECT word_length::VARCHAR AS key, count(*)::DOUBLE AS n, sum(is_correct::INTEGER)::DOUBLE AS correct,
      avg(is_correct::INTEGER) AS accuracy, avg(acc) AS mean_character_accuracy FROM rows GROUP BY word_length),
    spread AS (SELECT avg(acc) AS mean_accuracy, min(acc) AS min_accuracy, max(acc) AS max_accuracy FROM rows),
    report AS (
      SELECT 'totals' AS section, 'all' AS key, metric, value FROM (UNPIVOT totals ON samples, correct, accuracy INTO NAME metric VALUE value)
      UNION ALL SELECT 'by_length', key, metric, value FROM (UNPIVOT lengths
        ON n, correct, accuracy, mean_character_accuracy INTO NAME metric VALUE value)
      UNION ALL SELECT 'error_types', error_type, 'n', count(*)::DOUBLE FROM wrong GROUP BY error_type
      UNION ALL (SELECT 'error_prone_lengths', word_length::VARCHAR, 'n', count(*)::DOUBLE AS n FROM wrong
        GROUP BY word_length ORDER BY n DESC, word_length LIMIT 10)
      UNION ALL SELECT 'accuracy', 'all', metric, value FROM (UNPIVOT spread
        ON mean_accuracy, min_accuracy, max_accuracy INTO NAME metric VALUE value)
      UNION ALL (SELECT 'worst', doc_id || '/' || pos, 'character_accuracy', acc FROM rows ORDER BY acc, doc_id, pos LIMIT 5))
    SELECT section, key, metric, round(value, 9) + 0.0 AS value FROM report""",
)
def k2(spark, sf):
    """The report, written as a file and read back."""
    path = scratch_path(spark, "summary")
    writers.write_summary(ev.summary(stable(_analysis(spark, sf), "analysis"), ["doc_id", "pos"]), path)
    rows = spark.read.schema("section string, key string, metric string, value double").option("header", True).csv(path)
    return rows.withColumn("value", rounded("value", 9))


@query(
    "k1_analysis_csv",
    _ANALYSIS_SQL
    + """SELECT error_type, word_length, count(*) AS n, sum(character_errors)::BIGINT AS errors,
      sum(is_correct::INTEGER)::BIGINT AS correct FROM rows GROUP BY error_type, word_length""",
)
def k1(spark, sf):
    """The analysis written as CSV, read back and counted."""
    rows = _analysis(spark, sf).drop("character_accuracy_exact")
    path = scratch_path(spark, "analysis")
    writers.write_analysis(rows, path)
    back = spark.read.schema(rows.schema).option("header", True).option("escape", '"').csv(path)
    return back.groupBy("error_type", "word_length").agg(
        F.count("*").alias("n"),
        F.sum("character_errors").alias("errors"),
        F.sum(F.col("is_correct").cast("long")).alias("correct"),
    )
