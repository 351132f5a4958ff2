"""Change feeds: classification, tag index, sequences, and windowed aggregates.

Replication diffs are ordered by sequence; within one, by position in the file.
A tag index keeps the elements that match a predicate, as Parquet with the last
applied sequence.  The rules: a deletion removes, a matching version replaces, a
visible version that no longer matches removes; the last operation on an id wins;
a sequence that was applied before changes nothing, a gap is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def change_type(visible: Column, version: Column) -> Column:
    """Not visible: deleted; version 1 or less: added; else modified."""
    return F.when(~F.coalesce(visible, F.lit(True)), "deleted").when(version <= 1, "added").otherwise("modified")


def classify(changes: DataFrame) -> DataFrame:
    """Changes with change_type; deleted ones and those without a place have no geometry."""
    out = changes.withColumn("change_type", change_type(F.col("visible"), F.col("version")))
    for c in ("lon", "lat"):
        if c in out.columns:
            out = out.withColumn(c, F.when(F.col("change_type") != "deleted", F.col(c)))
    return out


def change_counts(classified: DataFrame) -> DataFrame:
    n = lambda k: F.coalesce(F.sum((F.col("change_type") == k).cast("long")), F.lit(0)).alias(k)
    return classified.agg(F.count(F.lit(1)).alias("changes"), n("added"), n("modified"), n("deleted"))


def last_operations(changes: DataFrame, key: str, *order: str) -> DataFrame:
    """The last operation on each id: one aggregation, with map-side combination."""
    return changes.groupBy(key).agg(F.max_by(F.struct(*[c for c in changes.columns if c != key]), F.struct(*order)).alias("__last")).select(key, "__last.*")


def apply_changes(index: DataFrame, changes: DataFrame, matches: Column, key: str = "osm_id", order: tuple[str, ...] = ("sequence", "seq_pos"), deleted: Column | None = None) -> DataFrame:
    """The index after the changes.  `matches` and `deleted` are predicates on change rows."""
    gone = deleted if deleted is not None else F.col("op") == "delete"
    last = last_operations(changes, key, *order).withColumn("__keep", ~F.coalesce(gone, F.lit(False)) & F.coalesce(matches, F.lit(False)))
    kept = index.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where("__keep").select(*index.columns))


#: Sequences in a range that the order is taken in.
RANGE = 1_000_000


def missing_sequences(sequences: DataFrame, column: str = "sequence") -> DataFrame:
    """Sequences that lack between the first and the last: of each two neighbours, what lies between them.

    Neighbours are found within ranges of RANGE sequences, so no task orders them
    all; the edges of the ranges are a small table.
    """
    known = sequences.where(F.col(column).isNotNull()).select(F.col(column).cast("long").alias("s")).distinct().withColumn("part", F.floor(F.col("s") / RANGE))
    inner = known.select("s", F.lead("s").over(Window.partitionBy("part").orderBy("s")).alias("next"))
    edges = known.groupBy("part").agg(F.min("s").alias("a"), F.max("s").alias("b"))
    outer = edges.select(F.col("b").alias("s"), F.lead("a").over(Window.orderBy("part")).alias("next"))
    gaps = inner.union(outer).where("next > s + 1")
    # a long gap is many rows: pieces of a range first, then their members
    pieces = gaps.select(F.explode(F.sequence(F.col("s") + 1, F.col("next") - 1, F.lit(RANGE).cast("long"))).alias("x"), "next")
    return pieces.select(F.explode(F.sequence("x", F.least(F.col("x") + RANGE - 1, F.col("next") - 1))).alias(column))


def cut_by_region(changes: DataFrame, areas: DataFrame) -> DataFrame:
    """One feed cut to many: changes with `region` of every area that they are in; a change in two areas goes to both."""
    from cartoframe.operators.spatial import matches

    return matches(changes.where("lon is not null and lat is not null"), areas).withColumn("region", F.col("area.region")).drop("area")


class TagIndex:
    """A maintained index under `path`: versions of Parquet, and a small state table with the last sequence.

    An update writes a new version and then its state row; a reader uses the
    version of the last state row, so an update that died halfway leaves no trace.
    """

    def __init__(self, spark: SparkSession, path: str, columns: str, matches: Column, key: str = "osm_id"):
        self.spark, self.path, self.columns, self.matches, self.key = spark, path.rstrip("/"), columns, matches, key

    def _state(self) -> tuple[int, int | None]:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/state")
        if not fs_path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(fs_path):
            return 0, None
        row = self.spark.read.schema("version long, sequence long").json(f"{self.path}/state").orderBy(F.desc("version")).first()
        return (row.version, row.sequence) if row else (0, None)

    def read(self) -> DataFrame:
        version, _ = self._state()
        return self.spark.read.schema(self.columns).parquet(f"{self.path}/v{version}") if version else self.spark.createDataFrame([], self.columns)

    @property
    def sequence(self) -> int | None:
        return self._state()[1]

    def _commit(self, df: DataFrame, version: int, sequence: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v{version}")
        self.spark.createDataFrame([(version, sequence)], "version long, sequence long").coalesce(1).write.mode("append").json(f"{self.path}/state")

    def rebuild(self, elements: DataFrame, sequence: int) -> None:
        """From a full extract; elements of overlapping extracts collapse by id."""
        names = [f.name for f in self.read().schema.fields]
        self._commit(elements.where(F.coalesce(self.matches, F.lit(False))).dropDuplicates([self.key]).select(*names), self._state()[0] + 1, sequence)

    def update(self, changes: DataFrame) -> bool:
        """Applies the sequences after the last one; False if there are none.  A gap is an error."""
        version, done = self._state()
        new = changes if done is None else changes.where(F.col("sequence") > done)
        first, last, n = new.agg(F.min("sequence"), F.max("sequence"), F.countDistinct("sequence")).first()
        if not n:
            return False
        if (done is not None and first != done + 1) or last - first + 1 != n:
            raise ValueError(f"a gap in the sequences after {done}: {n} of {first} to {last}")
        self._commit(apply_changes(self.read(), new, self.matches, self.key), version + 1, last)
        return True

    def follow(self, feed: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
        """Keeps the index up to date from a stream of changes; a replayed batch changes nothing."""
        writer = feed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: self.update(df) and None)
        return (writer.trigger(availableNow=True) if once else writer).start()


def _marked(events: DataFrame, time: str, late: str) -> DataFrame:
    """A stream with its watermark, which needs a timestamp with a zone: zone-less ones are taken in the session's."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes", time: str = "ts", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Extension: counts and sums in tumbling or sliding windows, with a watermark; the same on a stream and on a table."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    marked = _marked(events, time, late)
    return marked.groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes", time: str = "ts", key: str = "user_id") -> DataFrame:
    """Extension: sessions of a key that end after a gap."""
    marked = _marked(events, time, late)
    return marked.groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
