"""A kept index of a vocabulary's blocking keys, for fuzzy search without keying the vocabulary anew."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.operators.correction import near_pairs, probe_keys, vocabulary_keys
from quillframe.operators.packed_keys import one_run
from quillframe.session import stable


KEY_ROWS = 16  # rows of packed keys that are written and read together


class FuzzyIndex:
    """Written tables of one vocabulary: ``keys (key, candidates)`` bucketed by key and ``words`` by word.
    ``key`` is a group of blocking keys, and ``candidates`` are the group's keys with their words, packed; a large
    group has several rows.

    Both are files below ``path`` with a bucket specification in the catalog, so a search shuffles the
    probe's keys to the buckets and never the index. Words are added by increments that touch only
    the new words; ``compact`` joins the files of many increments into one generation again.

    A generation lies in its own folder and the ``current`` table names the one that counts, as its
    last row; a job that dies on the way leaves files that nobody reads. Keys are written before their words:
    what an increment has left of a word that is not yet listed is written again and counts once.
    """

    def __init__(self, spark: SparkSession, path: str, generation: int, buckets: int):
        self.spark, self.path, self.generation, self.buckets = spark, path.rstrip("/"), generation, buckets
        for kind, column in (("keys", "key"), ("words", "candidate")):
            columns = "key INT, candidates BINARY" if kind == "keys" else "candidate STRING"
            options = f"OPTIONS ('parquet.block.row.count.limit' '{KEY_ROWS}') " if kind == "keys" else ""
            spark.sql(
                f"CREATE TABLE IF NOT EXISTS {self._name(kind)} ({columns}) USING parquet {options}"
                f"CLUSTERED BY ({column}) SORTED BY ({column}) INTO {buckets} BUCKETS "
                f"LOCATION '{self._folder(kind)}'"
            )

    @classmethod
    def create(cls, vocabulary: DataFrame, path: str, buckets: int = 64, word: str = "w1") -> FuzzyIndex:
        """Index of the distinct words in ``vocabulary``, in an empty folder."""
        index = cls(vocabulary.sparkSession, path, 0, buckets)
        index._write(stable(vocabulary.select(F.col(word).alias("candidate")), "fresh"))
        index._point()
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FuzzyIndex:
        """The index in ``path``, in this or another session."""
        last = spark.read.schema("generation int, buckets int").parquet(f"{path.rstrip('/')}/current")
        row = last.orderBy(F.desc("generation")).first()
        return cls(spark, path, row["generation"], row["buckets"])

    @property
    def keys(self) -> DataFrame:
        return self.spark.table(self._name("keys"))

    @property
    def words(self) -> DataFrame:
        return self.spark.table(self._name("words"))

    def add(self, vocabulary: DataFrame, word: str = "w1") -> int:
        """Add the words that are not in the index yet; returns how many."""
        fresh = stable(
            vocabulary.select(F.col(word).alias("candidate"))
            .where(F.col(word).isNotNull())
            .distinct()
            .join(self.words, "candidate", "left_anti"),
            "fresh",
        )
        n = fresh.count()
        if n:
            self._write(fresh)
        return n

    def compact(self) -> FuzzyIndex:
        """The same index as a new generation with one run of files."""
        new = FuzzyIndex(self.spark, self.path, self.generation + 1, self.buckets)
        new._append(one_run(self.keys).select("key", "candidates"), "keys", "key")
        new._append(self.words.distinct().repartition(self.buckets, "candidate"), "words", "candidate")
        new._point()
        return new

    def search(self, unknown: DataFrame, word: str = "word") -> DataFrame:
        """All pairs ``(word, candidate, dist)`` within distance 2 of distinct words."""
        return near_pairs(stable(probe_keys(unknown, word), "probe"), self.keys, word)

    def forget(self) -> None:
        """Take the tables out of the catalog; the files stay."""
        for kind in ("keys", "words"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(kind)}")

    def _folder(self, kind: str) -> str:
        return f"{self.path}/{kind}-{self.generation}"

    def _name(self, kind: str) -> str:
        return f"fuzzy_{hashlib.md5(self._folder(kind).encode()).hexdigest()[:16]}_{kind}"

    def _write(self, words: DataFrame) -> None:
        keys = vocabulary_keys(words, "candidate").repartition(self.buckets, "key")
        self._append(one_run(keys).select("key", "candidates"), "keys", "key")
        self._append(words.repartition(self.buckets, "candidate"), "words", "candidate")

    def _append(self, rows: DataFrame, kind: str, column: str) -> None:
        # Rows come dealt out as the buckets are, so that each bucket gets one file.
        (
            rows.write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, column)
            .sortBy(column)
            .option("path", self._folder(kind))
            .saveAsTable(self._name(kind))
        )

    def _point(self) -> None:
        row = self.spark.range(1).select(
            F.lit(self.generation).alias("generation"), F.lit(self.buckets).alias("buckets")
        )
        row.write.mode("append").parquet(f"{self.path}/current")
