"""Toxic documents and their sentences by multiple-instance learning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm import words
from quillframe.session import stable

FEATURES = 1 << 20
MAX_ROWS = 16_384  # labelled documents that the model is fitted on
EPOCHS = 300
EVIDENCE = 10.0  # least Poisson likelihood ratio of a feature that may get a weight

_ASCII_PUNCTUATION = np.isin(np.arange(256), list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
_PARTS = words.SPACE | _ASCII_PUNCTUATION
_ENDS = np.isin(np.arange(256), list(b".!?\n"))


@dataclass
class Model:
    """Weight of each hashed word and the bias of a sentence."""

    weight: np.ndarray
    bias: float


def sentences(data: np.ndarray, bounds: np.ndarray):
    """Of some texts: features, the sentence each is in, and of the sentences that hold words the
    text and the bytes from and to (within the text).

    A feature is a hashed word, or four bytes in a row of one word and the byte before them, so that
    stems and endings count whatever they are joined to.
    """
    value, own, start = words.hashed_words(data, bounds, _PARTS, starts=True)
    none = np.zeros(0, dtype=np.int64)
    if len(value) == 0:
        return none, none, none, none, none
    raw = data[bounds[0] : bounds[-1]]
    at = bounds - bounds[0]
    cut = np.unique(np.concatenate([at[:-1], np.flatnonzero(_ENDS[raw]) + 1]))
    sentence = np.searchsorted(cut, start, side="right") - 1
    first = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]]))
    which = sentence[first]
    text = np.searchsorted(own, first, side="right") - 1

    # A zero before each text keeps runs inside their text, whatever texts share the batch.
    moved = np.arange(len(raw)) + np.repeat(np.arange(len(at) - 1), np.diff(at)) + 1
    low = np.zeros(len(raw) + len(at) + 7, dtype=np.uint8)
    low[moved] = np.where(_PARTS[raw], 0, words.LOWER[raw])
    back = np.zeros(len(low), dtype=np.int64)
    back[moved] = np.arange(len(raw))
    letter = low != 0
    place = np.flatnonzero(letter[1:-7] & letter[2:-6] & letter[3:-5] & letter[4:-4])
    eight = np.ndarray(shape=(len(low) - 7,), dtype="<u8", buffer=low, strides=(1,))
    run = words.mix(eight[place] & np.uint64((1 << 40) - 1))
    feature = np.concatenate([value, run]) % np.uint64(FEATURES)
    of = np.concatenate([sentence, np.searchsorted(cut, back[place + 1], side="right") - 1])
    ends = np.append(cut, at[-1])[which + 1]
    return (
        feature.astype(np.int64), np.searchsorted(which, of), text,
        cut[which] - at[text], ends - at[text],
    )


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def fit(
    feature: np.ndarray,
    sentence: np.ndarray,
    text: np.ndarray,
    label: np.ndarray,
    epochs: int = EPOCHS,
    rate: float = 0.2,
    l2: float = 1e-6,
) -> Model:
    """Fit sentence weights to document labels.

    A sentence is toxic with probability ``p = sigmoid(bias + sum of its features' weights)``, a
    document with ``1 - product(1 - p)`` (noisy-or). ``feature`` and ``sentence`` are pairs,
    ``text`` tells the document of each sentence. Adam steps on the log loss of the documents.
    """
    weight = np.zeros(FEATURES, dtype=np.float32)
    n = len(label)
    share = label.mean() if n else 0.0
    if share in (0.0, 1.0):
        return Model(weight, -12.0 if share < 1.0 else 12.0)
    chosen, column = np.unique(feature, return_inverse=True)
    w, m1, m2 = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    w[-1] = -4.0
    for step in range(1, epochs + 1):
        z = np.bincount(sentence, weights=w[column], minlength=len(text)) + w[-1]
        total = np.bincount(text, weights=_softplus(z), minlength=n)
        clear = np.exp(-np.maximum(total, 1e-9))
        slope = np.where(label == 1, -clear / (1 - clear), 1.0) / n
        pull = slope[text] * _sigmoid(z)
        grad = np.append(
            np.bincount(column, weights=pull[sentence], minlength=len(chosen)), pull.sum()
        )
        grad[:-1] += l2 * w[:-1]
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.99 * m2 + 0.01 * grad * grad
        w -= rate / (1 + step / 60) * m1 / (1 - 0.9**step) / (
            np.sqrt(m2 / (1 - 0.99**step)) + 1e-8
        )
    weight[chosen] = w[:-1]
    return Model(weight, float(w[-1]))


def train(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = MAX_ROWS,
    least: float = EVIDENCE,
) -> Model:
    """Fit on at most ``max_rows`` labelled documents, those with the least hash of the id.

    ``usable`` says of a row of ``labels`` whether it may be learned from; ids with several rows
    are toxic if one row says so. The executors count in how many documents, and toxic ones,
    each feature is; all with evidence of ``least`` or more may get a weight, so words of a few
    documents stay out. What the driver then fits on is the places of these features, of which
    there are at most ``FEATURES``, in the sentences of the bounded sample.

    Defined cases: null and empty texts have no features; labels that are null, or of a null or
    unknown id, are not learned from; a document that has several rows is learned from in each; other
    columns are ignored, whatever their names; without rows, or with labels of one kind, the
    model gives that kind to all texts (clean, where there are no rows).
    """
    chosen = (
        labels.where(usable & labels[label_col].isNotNull() & labels[id_col].isNotNull())
        .groupBy(labels[id_col].alias("doc_id"))
        .agg(F.max(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    texts = (
        docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
        .join(F.broadcast(chosen), "doc_id")  # at most max_rows ids
        .select("text", "label")
    )
    spark = docs.sparkSession

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, toxic = np.zeros(FEATURES, np.int64), np.zeros(FEATURES, np.int64)
        rows = bad = 0
        for batch in batches:
            label = batch.column(1).to_numpy()
            rows, bad = rows + len(label), bad + int(label.sum())
            data, at = words.texts_of(batch.column(0))
            for low, high in words.pieces(data, at):
                feature, sentence, text, _, _ = sentences(data, at[low : high + 1])
                if len(feature) == 0:
                    continue
                pair = np.unique(text[sentence] * FEATURES + feature)
                held = pair % FEATURES
                seen += np.bincount(held, minlength=FEATURES)
                toxic += np.bincount(held[label[low:high][pair // FEATURES] == 1], minlength=FEATURES)
        every = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(every, -1)), pa.array(np.append(seen[every], rows)),
             pa.array(np.append(toxic[every], bad))],
            ["feature", "seen", "toxic"],
        )

    counts = stable(
        texts.mapInArrow(counted, "feature long, seen long, toxic long")
        .groupBy("feature")
        .agg(F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic"))
        .where("toxic > 1 or feature < 0"),
        "features",
    )
    total = counts.where("feature < 0").first()
    share = total["toxic"] / total["seen"] if total and total["seen"] else 0.0
    expected = F.col("seen") * F.lit(share)
    ratio = 2 * (F.col("toxic") * F.log(F.col("toxic") / expected) - F.col("toxic") + expected)
    best = (
        counts.where((F.col("feature") >= 0) & (F.col("toxic") > expected) & (ratio >= least))
        .select("feature")
        .toArrow()["feature"]
        .to_numpy()
    ) if share else np.zeros(0, dtype=np.int64)
    wanted = spark.sparkContext.broadcast(np.sort(best))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = np.full(FEATURES, False)
        of[wanted.value] = True
        for batch in batches:
            data, at = words.texts_of(batch.column(0))
            for low, high in words.pieces(data, at):
                feature, sentence, text, _, _ = sentences(data, at[low : high + 1])
                use = of[feature] if len(feature) else np.zeros(0, bool)
                feature, sentence = feature[use], sentence[use]
                order = np.argsort(sentence, kind="stable")
                feature, sentence = feature[order], sentence[order]
                by_text = np.searchsorted(text, np.arange(high - low + 1))
                edge = np.searchsorted(sentence, by_text)
                local = sentence - np.repeat(by_text[:-1], np.diff(edge))
                lists = [
                    pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(x.astype(np.int32)))
                    for x in (feature, local)
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(low, high - low), pa.array(np.diff(by_text)), *lists],
                    ["label", "n", "feature", "sentence"],
                )

    got = texts.mapInArrow(
        featured, "label int, n long, feature array<int>, sentence array<int>"
    ).toArrow()
    if got.num_rows == 0:
        return fit(*[np.zeros(0, dtype=np.int64)] * 4)
    n = got["n"].to_numpy()
    each = got["feature"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    flat = [
        got[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        for c in ("feature", "sentence")
    ]
    return fit(
        flat[0],
        flat[1] + np.repeat(np.cumsum(n) - n, each),
        np.repeat(np.arange(len(n)), n),
        got["label"].to_numpy(),
    )


def _scored(data: np.ndarray, bounds: np.ndarray, weight: np.ndarray, bias: float):
    """Of some texts: minus the log probability of being clean; of their sentences: the
    probability, the text and the bytes from and to."""
    feature, sentence, text, start, end = sentences(data, bounds)
    z = np.bincount(sentence, weights=weight[feature], minlength=len(text)) + bias
    total = np.bincount(text, weights=_softplus(z), minlength=len(bounds) - 1)
    return total, _sigmoid(z), text, start, end


def drop_toxic(
    docs: DataFrame, model: Model, text_col: str = "text", at_least: float = 0.5
) -> DataFrame:
    """``docs`` without the rows that score ``at_least`` or more; all columns pass through.

    The scan that scores a text also drops it, so nothing is shuffled. Cases are those of ``score``.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))
    column = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = shared.value
        for batch in batches:
            data, at = words.texts_of(batch.column(column))
            keep = [
                -np.expm1(-_scored(data, at[low : high + 1], weight, bias)[0]) < at_least
                for low, high in words.pieces(data, at)
            ]
            yield batch.filter(pa.array(np.concatenate([*keep, np.zeros(0, bool)])))

    return docs.mapInArrow(work, docs.schema)


def score(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", at_least: float = 0.5
) -> DataFrame:
    """Toxicity of every whole text and its offending sentences.

    Returns doc_id, score (noisy-or of the sentences, 0 to 1), n_sentences and ``offending``: first
    and last byte (exclusive) in UTF-8 and probability of each sentence of ``at_least``.

    Defined cases: a null or empty text, or one without words, has no sentence and score 0;
    repeated rows and null ids are scored like any other; other columns are ignored, whatever their
    names; an empty table gives no rows. Without labels of both kinds the score is near the only one.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = shared.value
        for batch in batches:
            data, at = words.texts_of(batch.column(1))
            for low, high in words.pieces(data, at):
                rows = high - low
                total, p, text, start, end = _scored(data, at[low : high + 1], weight, bias)
                bad = np.flatnonzero(p >= at_least)
                spans = pa.StructArray.from_arrays(
                    [pa.array(start[bad]), pa.array(end[bad]), pa.array(p[bad])], fields=list(span)
                )
                edges = np.searchsorted(text[bad], np.arange(rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, rows), pa.array(-np.expm1(-total)),
                        pa.array(np.bincount(text, minlength=rows).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(edges), spans),
                    ],
                    ["doc_id", "score", "n_sentences", "offending"],
                )

    two = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return two.mapInArrow(
        work,
        "doc_id long, score double, n_sentences long, "
        "offending array<struct<start: long, end: long, score: double>>",
    )
