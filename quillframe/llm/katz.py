"""Katz back-off bigram model of a corpus and the score of every text."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm import words
from quillframe.session import scratch_path, stable

BLOCK_BYTES = 6 << 20  # text whose n-grams are counted together; at most 2**20 texts
BUCKET_BYTES = 8 << 20  # text for each bucket of n-grams
_ROW = 16  # bytes that a text counts besides its own, so that a block of empty texts is bounded too
CUT = 5  # counts up to this are discounted
ADD = 0.1

_START, _END = np.uint64(0x2545F4914F6CDD1D), np.uint64(0xDA942042E4DD58B5)
_ONE, _TWO = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)


def _by_kind(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder, partitioned by its kind of rows."""
    path = scratch_path(df.sparkSession, label)
    df.write.partitionBy("kind").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _planes(keys: np.ndarray) -> bytes:
    """Sorted keys byte by byte, so that the shuffle's compression removes their common high bytes."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _keys(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each key; rises with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class Block:
    """Tokens of some texts and their distinct unigrams and bigrams."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        value, own = words.hashed_words(data, bounds)
        n = len(bounds) - 1
        self.at = own + np.arange(n + 1)  # each text has one more token, its end
        self.token = np.full(len(value) + n, _END, dtype=np.uint64)
        text = np.repeat(np.arange(n), np.diff(own))
        self.token[np.arange(len(value)) + text] = value
        self.text = np.repeat(np.arange(n), np.diff(self.at))
        self.before = np.empty_like(self.token)
        self.before[1:] = self.token[:-1]
        self.before[self.at[:-1]] = _START
        one = words.mix(self.token ^ _ONE)
        two = words.mix(words.mix(self.before + _TWO) * _ONE ^ self.token)
        self.grams = [np.unique(k, return_index=True, return_inverse=True) for k in (one, two)]


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int, text: int):
    """Rows of a partition in runs that hold about ``block_bytes``, however they are batched."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 20
    held, size = [], 0
    for batch in batches:
        length = np.diff(words.texts_of(batch.column(text))[1]) + _ROW
        low = 0
        while low < batch.num_rows:
            reach = np.cumsum(length[low:]) + size
            take = int(np.searchsorted(reach, block_bytes)) + 1
            part = batch.slice(low, take)
            held.append(part)
            size = int(reach[part.num_rows - 1])
            low += part.num_rows
            if size >= block_bytes:
                yield number, pa.Table.from_batches(held)
                number, held, size = number + 1, [], 0
    if held:
        yield number, pa.Table.from_batches(held)


def _count(block_bytes: int, buckets: int):
    schema = pa.schema([
        ("size", pa.int32()), ("bucket", pa.int64()), ("block", pa.int64()),
        ("keys", pa.binary()), ("counts", pa.binary()),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in _blocks(batches, block_bytes, 1):
            block = Block(*words.texts_of(table.column(1)))
            learn = table.column(2).to_numpy()[block.text]
            for size, (keys, _, place) in enumerate(block.grams, 1):
                count = np.bincount(place[learn], minlength=len(keys)).astype("<u4")
                edges = np.searchsorted(_bucket(keys, buckets), np.arange(buckets + 1))
                some = np.flatnonzero(np.diff(edges))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(some), size, np.int32)), pa.array(some),
                        pa.array(np.full(len(some), number)),
                        pa.array([_planes(keys[edges[b] : edges[b + 1]]) for b in some], pa.binary()),
                        pa.array([count[edges[b] : edges[b + 1]].tobytes() for b in some], pa.binary()),
                    ],
                    schema=schema,
                )

    return work


def _total(table: pa.Table) -> pa.Table:
    """Of a bucket: for each block the corpus counts of its n-grams in its order, and which of
    them it answers for; and one row with the counts of counts."""
    keys = [_keys(x.as_buffer()) for x in table["keys"]]
    edges = np.cumsum([0, *map(len, keys)])
    each, place = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.frombuffer(b"".join(x.as_py() for x in table["counts"]), "<u4")
    total = np.bincount(place, weights=counts, minlength=len(each)).astype(np.int64)
    held = np.flatnonzero(counts)
    answers = np.zeros(len(place), dtype=np.uint8)
    _, first = np.unique(place[held], return_index=True)
    answers[held[first]] = 1
    # Four bytes hold all but the counts of the commonest n-grams of hundreds of gigabytes of text.
    width = 4 if total.max(initial=0) < 2**32 else 8
    back = total[place].astype(f"<u{width}")
    size = table["size"][0].as_py()
    low = np.bincount(total[total <= CUT + 1], minlength=CUT + 2)[1:]
    n = table.num_rows
    return pa.table({
        "kind": pa.array(["back"] * n + ["sum"]),
        "size": pa.array([size] * (n + 1), pa.int32()),
        "bucket": pa.array([*table["bucket"].to_pylist(), table["bucket"][0].as_py()], pa.int64()),
        "block": pa.array([*table["block"].to_pylist(), None], pa.int64()),
        "width": pa.array([width] * (n + 1), pa.int32()),
        "totals": pa.array([back[a:b].tobytes() for a, b in zip(edges, edges[1:])] + [None], pa.binary()),
        "answers": pa.array(
            [np.packbits(answers[a:b]).tobytes() for a, b in zip(edges, edges[1:])] + [None], pa.binary()
        ),
        "of_counts": pa.array(
            [None] * n + [[int(total.sum()), int((total > 0).sum()), *map(int, low)]], pa.list_(pa.int64())
        ),
    })


def good_turing(of_counts: list[int], cut: int = CUT) -> np.ndarray:
    """Discount factor of each count up to ``cut`` (Katz); 1 where the counts of counts allow none.

    ``of_counts[r - 1]`` n-grams were seen ``r`` times, for ``r`` up to ``cut + 1``.
    """
    n = np.array(of_counts, dtype=np.float64)
    factor = np.ones(cut + 1)
    if n[0] == 0:
        return factor
    tail = (cut + 1) * n[cut] / n[0]
    for r in range(1, cut + 1):
        if n[r - 1] > 0 and tail < 1:
            d = ((r + 1) * n[r] / (r * n[r - 1]) - tail) / (1 - tail)
            factor[r] = d if 0 < d < 1 else 1.0
    return factor


def score(
    docs: DataFrame,
    learns: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Log10 probability of every text in a Katz bigram model of the texts that ``learns`` picks.

    Tokens are the words (``words.hashed_words``) and one end for each text; the first token's
    context is a start mark. A seen bigram has probability ``d_r r / (c + 1)``, ``r`` its count,
    ``c`` its context's and ``d_r`` the Good-Turing discount of counts up to 5; an unseen one backs
    off to ``alpha(context)`` times the unigram's ``(count + 0.1) / (N + 0.1 (V + 1))``, where an unknown
    word is one class. What the discounts and the one count set aside in each context leave is
    divided by the unigram mass of the words not seen in the context, so all probabilities of a context
    sum to one, exactly. A context that was never seen backs off with weight 1.

    1. Consecutive texts of a partition are a block. A block counts its n-grams and sends the
       distinct ones, sorted, to buckets by hash; a frequent n-gram is one entry of each block.
    2. A bucket adds the blocks' counts and answers each block in the block's order, so n-grams
       travel once. The answers are a table partitioned by kind, which also has the counts of counts.
    3. Blocks meet their answers. Each sums the seen part of its texts, and for the bigrams it
       answers for the parts of the contexts' weights; these meet by hash of the context.
    4. The contexts of tokens that back off meet the weights' table.

    Every step's tasks hold one block or one bucket, and the numbers of both follow the
    corpus; nothing is broadcast and only the counts of counts reach the driver. The table of texts must be
    read in the same blocks twice (as a table of files is); the answers' lengths show if it was not, and the
    job stops.

    Returns doc_id, learned, n_tokens, n_known, train_tokens, base_score, score. Defined cases: a null or
    empty text is its end alone; null ids and repeated rows are scored (and learned from) like any
    other; other columns are ignored; an empty table gives no rows; with nothing to learn from,
    all is unknown.
    """
    three = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        docs[text_col].alias("text"),
        F.coalesce(learns, F.lit(False)).alias("learns"),
    )
    size = three.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, math.ceil(size / bucket_bytes))
    answered = _by_kind(
        three.mapInArrow(
            _count(block_bytes, buckets), "size int, bucket long, block long, keys binary, counts binary"
        )
        .groupBy("size", "bucket")
        .applyInArrow(
            _total,
            "kind string, size int, bucket long, block long, width int, totals binary, answers binary, "
            "of_counts array<long>",
        ),
        "answered",
    )
    sums = answered.where("kind = 'sum'").groupBy("size").agg(
        *[F.sum(F.get("of_counts", F.lit(i))).alias(str(i)) for i in range(CUT + 3)]
    )
    found = {r["size"]: list(r)[1:] for r in sums.collect()}  # two rows
    tokens, types = (found.get(1) or [0, 0])[:2]
    discount = good_turing(found[2][2:] if 2 in found else [0] * (CUT + 1))
    whole = tokens + ADD * (types + 1)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in _blocks(batches, block_bytes, 1):
            place = 0
            for batch in table.to_batches():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(batch.num_rows, number)),
                        pa.array(np.arange(place, place + batch.num_rows)), *batch.columns,
                    ],
                    ["block", "place", "doc_id", "text", "learns"],
                )
                place += batch.num_rows

    texts = three.mapInArrow(
        numbered, "block long, place long, doc_id long, text string, learns boolean"
    )
    back = answered.where("kind = 'back'").select("block", "size", "bucket", "width", "totals", "answers")
    scored = _by_kind(
        texts.groupBy("block")
        .cogroup(back.groupBy("block"))
        .applyInArrow(
            lambda left, right: _evaluate(left, right, discount, whole, buckets),
            "kind string, uid long, doc_id long, learned boolean, n_tokens long, n_known long, base double, "
            "part double, bucket long, keys binary, values binary, contexts array<long>, times array<int>",
        ),
        "scored",
    )
    weights = stable(
        scored.where("kind = 'context'")
        .groupBy("bucket")
        .applyInArrow(lambda t: _weights(t, whole), "context long, alpha double"),
        "weights",
    )
    needs = scored.where("kind = 'text'").where(F.size("contexts") > 0).select(
        "uid", F.explode(F.arrays_zip("contexts", "times")).alias("x")
    ).select("uid", F.col("x.contexts").alias("context"), F.col("x.times").alias("times"))
    backed = (
        needs.join(weights, "context")
        .groupBy("uid")
        .agg(F.sum(F.col("times") * F.log10("alpha")).alias("backed"))
    )
    return scored.where("kind = 'text'").join(backed, "uid", "left").select(
        "doc_id",
        "learned",
        "n_tokens",
        "n_known",
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        (F.col("part") + F.coalesce("backed", F.lit(0.0))).alias("score"),
    )


def _evaluate(left: pa.Table, right: pa.Table, discount: np.ndarray, whole: float, buckets: int) -> pa.Table:
    left = left.sort_by("place")
    block = Block(*words.texts_of(left["text"]))
    right = right.sort_by([("size", "ascending"), ("bucket", "ascending")])
    sizes = right["size"].to_numpy()
    total, answers = [], []
    for size, (keys, _, _) in enumerate(block.grams, 1):
        rows = np.flatnonzero(sizes == size)
        widths = right["width"].to_numpy()
        parts = [
            np.frombuffer(right["totals"][int(i)].as_buffer(), f"<u{widths[i]}").astype(np.int64) for i in rows
        ]
        total.append(np.concatenate([*parts, np.zeros(0, np.int64)]))
        bits = [
            np.unpackbits(np.frombuffer(right["answers"][int(i)].as_buffer(), np.uint8))[: len(p)]
            for i, p in zip(rows, parts)
        ]
        answers.append(np.concatenate([*bits, np.zeros(0, np.uint8)]).astype(bool))
        if len(total[-1]) != len(keys):
            raise RuntimeError("the texts were read in other blocks than the ones that were counted")
    (_, _, of_one), (_, where_two, of_two) = block.grams
    n = len(left)
    count, pair = total[0][of_one], total[1][of_two]
    ends = count[block.at[1:] - 1]
    context = np.empty_like(count)
    context[1:] = count[:-1]
    context[block.at[:-1]] = ends  # as many starts as ends

    def per_text(values: np.ndarray) -> np.ndarray:
        return np.bincount(block.text, weights=values, minlength=n)

    low = np.log10((count + ADD) / whole)
    seen = pair > 0
    factor = np.where(pair <= CUT, discount[np.minimum(pair, CUT)], 1.0)
    high = np.log10(np.where(seen, factor * pair / (context + 1.0), 1.0))
    backs = ~seen & (context > 0)
    of = block.text[backs]
    order = np.lexsort((block.before[backs], of))
    of, need = of[order], block.before[backs][order]
    fresh = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (need[1:] != need[:-1])])[: len(of)])
    times = np.diff(np.append(fresh, len(of)))
    need, edge = need[fresh], np.searchsorted(of[fresh], np.arange(n + 1)).astype(np.int32)

    mine = where_two[answers[1]]
    share = np.where(pair[mine] <= CUT, (1 - discount[np.minimum(pair[mine], CUT)]) * pair[mine], 0.0)
    of_context, at = np.unique(block.before[mine], return_inverse=True)
    freed = np.bincount(at, weights=share, minlength=len(of_context))
    mass = np.bincount(at, weights=count[mine] + ADD, minlength=len(of_context))
    times_seen = np.zeros(len(of_context))
    times_seen[at] = context[mine]
    values = np.stack([freed, mass, times_seen])
    by_bucket = np.searchsorted(_bucket(of_context, buckets), np.arange(buckets + 1))
    some = np.flatnonzero(np.diff(by_bucket))
    runs = [(by_bucket[b], by_bucket[b + 1]) for b in some]
    m = len(some)
    number = left["block"][0].as_py()
    uid = (number << 20) + np.arange(n)

    def both(kind: pa.DataType, of_texts, of_contexts) -> pa.Array:
        first = pa.nulls(n, kind) if of_texts is None else pa.array(of_texts, kind)
        last = pa.nulls(m, kind) if of_contexts is None else pa.array(of_contexts, kind)
        return pa.concat_arrays([first, last])

    contexts = pa.ListArray.from_arrays(pa.array(edge), pa.array(need.view(np.int64)))
    repeats = pa.ListArray.from_arrays(pa.array(edge), pa.array(times.astype(np.int32)))
    return pa.table({
        "kind": both(pa.string(), ["text"] * n, ["context"] * m),
        "uid": both(pa.int64(), uid, None),
        "doc_id": pa.concat_arrays([left["doc_id"].combine_chunks(), pa.nulls(m, pa.int64())]),
        "learned": pa.concat_arrays([left["learns"].combine_chunks(), pa.nulls(m, pa.bool_())]),
        "n_tokens": both(pa.int64(), np.diff(block.at), None),
        "n_known": both(pa.int64(), per_text(count > 0).astype(np.int64), None),
        "base": both(pa.float64(), per_text(low), None),
        "part": both(pa.float64(), per_text(np.where(seen, high, low)), None),
        "bucket": both(pa.int64(), None, some),
        "keys": both(pa.binary(), None, [_planes(of_context[a:b]) for a, b in runs]),
        "values": both(pa.binary(), None, [values[:, a:b].tobytes() for a, b in runs]),
        "contexts": pa.concat_arrays([contexts, pa.nulls(m, contexts.type)]),
        "times": pa.concat_arrays([repeats, pa.nulls(m, repeats.type)]),
    })


def _weights(table: pa.Table, whole: float) -> pa.Table:
    """Back-off weight of each context of a bucket."""
    keys = np.concatenate([_keys(x.as_buffer()) for x in table["keys"]])
    values = np.concatenate(
        [np.frombuffer(x.as_buffer(), np.float64).reshape(3, -1) for x in table["values"]], axis=1
    )
    each, at = np.unique(keys, return_inverse=True)
    freed = np.bincount(at, weights=values[0], minlength=len(each))
    mass = np.bincount(at, weights=values[1], minlength=len(each))
    times = np.zeros(len(each))
    times[at] = values[2]
    alpha = (1 + freed) / (times + 1) / (1 - mass / whole)
    return pa.table({"context": pa.array(each.view(np.int64)), "alpha": pa.array(alpha)})
