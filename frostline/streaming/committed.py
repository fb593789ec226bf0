"""Output tables of foreachBatch streams of which readers see whole micro-batches only.

A micro-batch is written to folders `<out>/<table>/batch_id=<n>`, one for each table, and then committed by one small
file `<out>/_commits/batch-<n>`, which appears at once or not at all. `read_table` reads committed folders only, so that
a writer that dies half way, or is writing at the moment, is not seen, and no table is ahead of another. A micro-batch
that is run again after its commit is left alone.

`compact` rewrites the micro-batches since the last compaction as one run with a folder for each customer and day, and
commits that in the same way; from then on readers use the run in place of the batch folders, which `drop_compacted`
removes once no reader of the old list is left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("aggregates", "alerts", "dead_letters")
#: What each table is laid out by: a column for whose it is, and the seconds that give the day.
LAYOUT = {
    "aggregates": ("customer_id", "window_start"),
    "alerts": ("customer_id", "timestamp"),
    "dead_letters": ("source_topic", "failed_at"),
}
DAY = "day"


def _path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    place, fs = _path(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []


def _mark(spark: SparkSession, out: str, name: str) -> None:
    """A commit file: written aside, then renamed into place."""
    aside, fs = _path(spark, f"{out}/_commits/.{name}")
    stream = fs.create(aside, True)
    stream.close()
    done, _ = _path(spark, f"{out}/_commits/{name}")
    if not fs.rename(aside, done) and not fs.exists(done):
        raise OSError(f"cannot commit {done}")


@dataclass(frozen=True)
class Commits:
    """Runs (first and last micro-batch) and micro-batches after the last run, in order."""

    runs: tuple[tuple[int, int], ...]
    batches: tuple[int, ...]

    @property
    def through(self) -> int:
        """The last micro-batch that is in a run."""
        return self.runs[-1][1] if self.runs else -1


def commits(spark: SparkSession, out: str) -> Commits:
    names = _names(spark, f"{out}/_commits")
    runs = sorted(tuple(map(int, n.split("-")[1:])) for n in names if n.startswith("run-"))
    through = runs[-1][1] if runs else -1
    batches = sorted(int(n.split("-")[1]) for n in names if n.startswith("batch-"))
    return Commits(tuple(runs), tuple(b for b in batches if b > through))


def is_committed(spark: SparkSession, out: str, batch_id: int) -> bool:
    place, fs = _path(spark, f"{out}/_commits/batch-{batch_id}")
    return fs.exists(place)


def commit_batch(spark: SparkSession, out: str, batch_id: int) -> None:
    """Make the folders of a micro-batch visible, those of all tables at once."""
    _mark(spark, out, f"batch-{batch_id}")


def read_table(spark: SparkSession, out: str, table: str) -> DataFrame:
    """The rows of all committed micro-batches of one table."""
    seen = commits(spark, out)
    owner, _ = LAYOUT[table]
    parts = []
    if seen.batches:
        parts.append(spark.read.parquet(*[f"{out}/{table}/batch_id={b}" for b in seen.batches]))
    for first, last in seen.runs:
        run = f"{out}/{table}/run={first}-{last}"
        # Types of partition columns are given, as a customer id made of digits stays text.
        reader = spark.read.option("basePath", run)
        parts.append(reader.schema(_typed(reader.parquet(run), owner)).parquet(run).drop(DAY))
    if not parts:
        raise ValueError(f"{out} holds no committed micro-batch")
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more.select(*rows.columns))
    return rows


def _typed(rows: DataFrame, owner: str) -> str:
    """The schema of a run, with the partition columns as what they were."""
    kinds = {owner: "string", DAY: "date"}
    return ", ".join(f"`{f.name}` {kinds.get(f.name, f.dataType.simpleString())}" for f in rows.schema.fields)


def compact(spark: SparkSession, out: str, tables: tuple[str, ...] = TABLES) -> tuple[int, int] | None:
    """Rewrite the micro-batches since the last run as a run of their own; its first and last, or None if there are none.

    Rows go to a folder for each customer and day. Spark's rebalance joins small parts and splits large ones, so there
    are few files and a customer with very many rows is written by several tasks. Earlier runs are not touched, so each
    row is rewritten once.
    """
    seen = commits(spark, out)
    if not seen.batches:
        return None
    first, last = seen.batches[0], seen.batches[-1]
    for table in tables:
        folders = [f"{out}/{table}/batch_id={b}" for b in seen.batches]
        if not all(_path(spark, f)[1].exists(_path(spark, f)[0]) for f in folders):
            continue  # a stream that does not write this table
        owner, seconds = LAYOUT[table]
        rows = spark.read.parquet(*folders).withColumn(DAY, F.to_date(F.timestamp_seconds(seconds)))
        run = rows.hint("rebalance", owner, DAY)
        run.write.mode("overwrite").partitionBy(owner, DAY).parquet(f"{out}/{table}/run={first}-{last}")
    _mark(spark, out, f"run-{first}-{last}")
    return first, last


def drop_compacted(spark: SparkSession, out: str, tables: tuple[str, ...] = TABLES) -> int:
    """Delete the folders of micro-batches that are in a run, and how many there were. Commit files stay, so that no
    micro-batch is ever taken for a new one."""
    through, gone = commits(spark, out).through, 0
    for table in tables:
        for name in _names(spark, f"{out}/{table}"):
            if name.startswith("batch_id=") and int(name.removeprefix("batch_id=")) <= through:
                place, fs = _path(spark, f"{out}/{table}/{name}")
                gone += fs.delete(place, True)
    return gone
