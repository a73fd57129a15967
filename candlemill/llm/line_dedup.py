"""Line dedup over batches of documents, in DataFrame operations only.

What earlier batches held is kept as sorted runs of line hashes, bucketed by hash. A new batch becomes a sorted run
itself and is merge-joined with those of each level; the hashes that none of them has are added as one more run.
When a level has as many runs as the fan-out, they are compacted to one run of the next level, so a batch meets a
number of runs that grows with the logarithm of the batches. The runs never move: they are read bucket by bucket in
their order, and only the batch is shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlemill.session import fresh_path, stage

SHORTEST = 10
BATCHES = 6
FANOUT = 4
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Bucketed tables have one sorted file a bucket here; without this Spark sorts them once more.
KEEP_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def line_key(line: Column) -> Column:
    """Without ASCII white space at both ends, A to Z in lower case."""
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def line_hash(key: Column) -> Column:
    """The first 128 bits of the SHA-256."""
    return F.unhex(F.substring(F.sha2(key, 256), 1, 32))


def _whole(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def hashed_lines(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, fp, pos, line: the hash of each line whose key has at least ``shortest`` code points.

    ``fp`` is a 64-bit hash of the text, which tells apart different texts under one id.
    """
    text = docs.select("doc_id", _whole().alias("_t"))
    lines = text.select("doc_id", F.xxhash64("_t").alias("fp"), F.posexplode(F.split("_t", "\n", -1)).alias("pos", "_l"))
    keys = lines.select("doc_id", "fp", "pos", line_key(F.col("_l")).alias("_k")).where(F.char_length("_k") >= shortest)
    return keys.select("doc_id", "fp", "pos", line_hash(F.col("_k")).alias("line"))


class LineRuns:
    """The lines seen so far, as levels of sorted runs in ``folder`` (by default in the session's shared folder).

    ``admit`` takes the hashed lines of a batch. ``save`` writes which runs there are, and ``LineRuns.load`` goes on
    from there in another application; a batch that was admitted after the last ``save`` is then unknown and can be
    admitted again. A run holds 16 bytes a line, in ``buckets`` files (the session's shuffle partitions, unless given).
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None, fanout: int = FANOUT) -> None:
        if fanout < 2:
            raise ValueError("fanout must be 2 or more")
        self.spark, self.fanout = spark, fanout
        self.folder = folder.rstrip("/") if folder else fresh_path(spark, "line-runs")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = []  # (table, path) of each run, by level
        self._tables: list[str] = []

    def _name(self, path: str, columns: str) -> str:
        """A table over a folder of bucketed files."""
        table = f"line_run_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (line) SORTED BY (line) "
            f"INTO {self.buckets} BUCKETS LOCATION '{path}'")
        self._tables.append(table)
        return table

    def _write(self, df: DataFrame, label: str) -> tuple[str, str]:
        table, path = f"line_run_{uuid.uuid4().hex}", f"{self.folder}/{label}-{uuid.uuid4().hex}"
        with self._ordered():
            df.write.format("parquet").bucketBy(self.buckets, "line").sortBy("line").option("path", path).saveAsTable(table)
        self._tables.append(table)
        return table, path

    @contextmanager
    def _ordered(self):
        before = self.spark.conf.get(KEEP_ORDER)
        self.spark.conf.set(KEEP_ORDER, "true")
        try:
            yield
        finally:
            self.spark.conf.set(KEEP_ORDER, before)

    def admit(self, lines: DataFrame) -> DataFrame:
        """The rows of ``lines`` (doc_id, line and more) that go: those whose line an earlier batch had, or whose
        document is not the one of the smallest id that has it in this batch. A null id counts as the largest, and
        all rows without an id as one document.

        One shuffle makes the batch's run, after hashes are merged within each task, so a line that a third of
        all rows hold is a row a task. A second one takes the rows to those lines that lose any; there
        Spark splits what a frequent line makes too large.
        """
        id_, read = F.col("doc_id"), self.spark.table
        several = (F.min(id_) < F.max(id_)) | ((F.count(id_) > 0) & (F.count(id_) < F.count("*")))
        mine = lines.groupBy("line").agg(F.min(id_).alias("owner"), several.alias("several"))
        batch = read(self._write(mine, "batch")[0])
        fresh = batch
        for level in self.levels:
            for table, _ in level:
                fresh = fresh.join(read(table), "line", "left_anti")
        run = self._write(fresh.select("line"), "run")
        # new lines that one document has lose nothing; the others do, all of theirs or all but the owner's
        with self._ordered():
            known = read(run[0]).select("line", F.lit(True).alias("new"))
            losing = stage(batch.join(known, "line", "left").where("several OR new IS NULL").select("line", "owner", "new"), "losing")
        self._add(run, 0)
        return lines.join(losing, "line").where(F.col("new").isNull() | ~F.col("owner").eqNullSafe(id_)).drop("line", "owner", "new")

    def _add(self, run: tuple[str, str], level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            # the runs of a level have no line in common
            parts = [self.spark.table(t) for t, _ in self.levels[level]]
            merged = parts[0]
            for part in parts[1:]:
                merged = merged.union(part)
            merged = self._write(merged.repartition(self.buckets, "line"), "run")
            self.levels[level] = []
            self._add(merged, level + 1)

    def save(self) -> None:
        """Write the list of runs; the newest list counts."""
        rows = [(i, path, self.buckets, self.fanout) for i, level in enumerate(self.levels) for _, path in level]
        lists = self._lists()
        number = 1 + max(lists, default=0)
        self.spark.createDataFrame(rows, "level int, path string, buckets int, fanout int").coalesce(1).write.parquet(
            f"{self.folder}/list-{number:012d}")

    def _lists(self) -> list[int]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        names = [f.getPath().getName() for f in files.listStatus(root)]
        done = lambda n: files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))
        return [int(n[5:]) for n in names if n.startswith("list-") and done(n)]

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> LineRuns:
        """The runs of the newest list in ``folder``."""
        runs = cls(spark, folder)
        lists = runs._lists()
        if not lists:
            raise FileNotFoundError(f"no list of runs in {folder}")
        rows = sorted(map(tuple, spark.read.parquet(f"{runs.folder}/list-{max(lists):012d}").collect()))
        for level, path, buckets, fanout in rows:
            runs.buckets, runs.fanout = buckets, fanout
            while len(runs.levels) <= level:
                runs.levels.append([])
            runs.levels[level].append((runs._name(path, "line BINARY"), path))
        return runs

    def forget(self) -> None:
        """Take the tables' names out of the catalog; the files stay."""
        for table in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._tables = []


def _batched(lines: DataFrame, bounds: Sequence[int]) -> list[DataFrame]:
    """Stored hashed lines, by batch: ids up to the first bound, up to the second, and so on; null ids last."""
    spark = lines.sparkSession
    number = F.lit(0)
    for bound in bounds:
        number = number + (F.col("doc_id") >= bound).cast("int")
    path = fresh_path(spark, "lines")
    dealt = lines.withColumn("_batch", F.coalesce(number, F.lit(len(bounds))))
    dealt.write.partitionBy("_batch").parquet(path)
    stored = spark.read.schema(dealt.schema).parquet(path)
    return [stored.where(F.col("_batch") == b).drop("_batch") for b in range(len(bounds) + 1)]


def repeated_lines(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, fp, dropped (positions from 0): the lines of each document that a smaller id holds.

    The documents go through ``LineRuns`` in batches of ascending ids, so the batch that had a line first has the
    smallest id that holds it. Where the batches are cut (at approximate quantiles) changes no result.
    """
    spark = docs.sparkSession
    shares = [i / batches for i in range(1, batches)]
    bounds = sorted({int(b) for b in docs.select("doc_id").approxQuantile("doc_id", shares, 0.02)}) if shares else []
    runs = LineRuns(spark, fanout=fanout)
    gone = None
    for batch in _batched(hashed_lines(docs, shortest), bounds):
        now = runs.admit(batch).distinct()
        gone = now if gone is None else gone.union(now)
    found = stage(gone.groupBy("doc_id", "fp").agg(F.collect_list("pos").alias("dropped")), "dropped-lines")
    runs.forget()
    return found


def without_lines(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """_row (a struct of the columns of ``docs``), n_lines, n_dropped, kept (the text that is left)."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), _whole().alias("_t"))
    rows = rows.withColumn("_fp", F.xxhash64("_t"))
    there = dropped.select(F.col("doc_id").alias("_gone_id"), F.col("fp").alias("_gone_fp"), "dropped")
    joined = rows.join(there, F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_fp") == F.col("_gone_fp")), "left")
    lines = F.split("_t", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "dropped")
    kept = F.when(F.col("dropped").isNull(), F.col("_t")).otherwise(F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n"))
    return joined.withColumn("_lines", lines).select(
        "_row", F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def drop_repeated_lines(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, shortest: int = SHORTEST) -> DataFrame:
    """The rows of ``docs`` with ``text`` less the lines that another document of a smaller id holds.

    Lines are cut at line feeds and compared without white space at their ends, A to Z in lower case; keys of
    less than ``shortest`` code points always stay. A line repeated within the document that keeps it stays there
    each time. A null or empty text is one empty line; a null text becomes empty. Rows that share an id are one
    document and take no lines from one another; rows without an id are one document, after all others. Other columns come through,
    whatever their names. An empty table gives an empty result. Ids are numbers.
    """
    found = without_lines(docs, repeated_lines(docs, batches, fanout, shortest))
    return found.select(*(F.col("kept").alias("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns))


def line_report(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256: one row per row of ``docs``, by the rules of ``drop_repeated_lines``."""
    docs = docs.select("doc_id", "text")
    found = without_lines(docs, repeated_lines(docs, batches, fanout, shortest))
    return found.select("_row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
