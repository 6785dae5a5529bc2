"""N-gram counts that grow file by file and equal a count of everything at once."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.operators.ngrams import (
    CHUNK_ROWS,
    LanguageModel,
    segment_edges,
    totals,
    windows_at_ends,
)
from quillframe.operators.packed_counts import merge, pack_rows, pack_windows, repack
from quillframe.session import stable

_LOG = "name string, folder string, covers array<string>, buckets int"


class KeptCounts:
    """Counts of n-grams over one running token sequence whose segments come in files, in any order.

    A file leaves a delta below ``path``: the counts of the windows inside its segments, and the few
    tokens at both ends of each segment. What runs over the end of a segment depends on its
    neighbours in the global order, which a later file may change, so only these edges are ordered
    when counts are asked for; the windows inside are added up. ``compact`` adds deltas together.

    A delta counts from the moment its row is in the log: files of a job that died before are
    overwritten by the next try, and a name that is in the log is not added twice. One writer at a time.
    ``order`` names the columns that order the segments; they are unique over all files.

    Counts are kept packed in ``buckets``, each of which is counted in one piece; the number that the first
    file was written with holds for all later ones. About 16 MB of text for each is a good size.
    """

    def __init__(
        self, spark: SparkSession, path: str, order: Sequence[str], n: int = 3, chunk_rows: int = CHUNK_ROWS,
        buckets: int = 64,
    ):
        self.spark, self.path, self.order, self.n = spark, path.rstrip("/"), list(order), n
        self.chunk_rows = chunk_rows
        first = self._log().first()
        self.buckets = first["buckets"] if first else buckets
        self.names = [f"w{i + 1}" for i in range(n)]

    def add(self, name: str, segments: DataFrame, tokens: str = "tokens") -> bool:
        """Add the segments of the file ``name``; false if the file is in already."""
        if not self._log().where(F.col("name") == name).isEmpty():
            return False
        self._commit(name, self._write(name, segments, tokens), [])
        return True

    def counts(self, k: int | None = None) -> DataFrame:
        """Counts ``(w1 .. wk, n)`` of all k-grams, ``k`` up to ``n``."""
        k = k or self.n
        names = self.names[:k]
        known = self._windows().where(F.col(names[-1]).isNotNull())
        return known if k == self.n else known.groupBy(*names).agg(F.sum("n").alias("n"))

    def model(self) -> LanguageModel:
        """The language model of the counts, longest n-grams summed once."""
        windows = stable(self._windows(), "windows")
        tables = []
        for k in range(1, self.n + 1):
            known = windows.where(F.col(self.names[k - 1]).isNotNull())
            tables.append(stable(known.groupBy(*self.names[:k]).agg(F.sum("n").alias("n")), "ngrams"))
        size = totals(tables[0]).first()
        return LanguageModel(size["vocabulary"], size["tokens"], *tables)

    def compact(self) -> None:
        """One delta in place of all; counts don't change, and the names stay known."""
        live = self._live()
        if len(live) < 2:
            return
        name = f"compacted-{uuid.uuid4().hex}"
        folder = self._folder(name)
        repack(self._read("grams", live), self.n).write.mode("overwrite").parquet(f"{self.path}/grams/{folder}")
        self._read("edges", live).write.mode("overwrite").parquet(f"{self.path}/edges/{folder}")
        self._commit(name, folder, live)

    def _folder(self, name: str) -> str:
        return hashlib.md5(name.encode()).hexdigest()

    def _write(self, name: str, segments: DataFrame, tokens: str = "tokens") -> str:
        folder = self._folder(name)
        grams = pack_windows(segments, self.n, self.buckets, tokens)
        grams.write.mode("overwrite").parquet(f"{self.path}/grams/{folder}")
        segment_edges(segments, self.order, self.n, tokens).write.mode("overwrite").parquet(
            f"{self.path}/edges/{folder}"
        )
        return folder

    def _commit(self, name: str, folder: str, covers: list[str]) -> None:
        row = self.spark.createDataFrame([(name, folder, covers, self.buckets)], _LOG)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def _log(self) -> DataFrame:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], _LOG)
        return self.spark.read.schema(_LOG).parquet(f"{self.path}/log")

    def _live(self) -> list[str]:
        """Folders that count: one per file since the last compaction."""
        log = self._log()
        covered = log.select(F.explode("covers").alias("folder"))
        return sorted(r["folder"] for r in log.join(covered, "folder", "left_anti").select("folder").collect())

    def _read(self, kind: str, live: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{kind}/{folder}" for folder in live])

    def _windows(self) -> DataFrame:
        """Counts of all windows, null past the end of the sequence."""
        live = self._live()
        if not live:
            columns = ", ".join(f"{w} string" for w in self.names)
            return self.spark.createDataFrame([], f"{columns}, n long")
        across = windows_at_ends(self._read("edges", live), self.order, self.n, self.chunk_rows)
        packed = pack_rows(across, self.names, self.buckets)
        return merge(self._read("grams", live).select("bucket", "grams").union(packed), self.names)
