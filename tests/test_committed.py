"""Committed output tables: dead writers, repeated micro-batches, compaction."""

import os

import pytest
from pyspark.sql import functions as F

from frostline.streaming import committed
from frostline.streaming import queries as streams
from tests.test_streaming import ONCE, rows_of, source, write_parts
from tests.test_windows import random_events


def rows(spark, batch, n=4):
    return spark.createDataFrame([(f"0{i % 2}", 1.7e9 + 86_400 * (i % 3), batch, i) for i in range(n)], "customer_id STRING, window_start DOUBLE, b INT, i INT")


def write(spark, out, batch, commit=True, n=4):
    streams.write_batch(rows(spark, batch, n), f"{out}/aggregates", batch)
    streams.write_batch(rows(spark, batch, n).withColumnRenamed("window_start", "timestamp"), f"{out}/alerts", batch)
    if commit:
        committed.commit_batch(spark, out, batch)


def seen(spark, out, table="aggregates"):
    return {r.b for r in committed.read_table(spark, out, table).collect()}


def files(out, table):
    return sum(n.endswith(".parquet") for _, _, names in os.walk(f"{out}/{table}") for n in names)


def test_a_dead_writer_is_not_seen(spark, tmp_path):
    out = str(tmp_path)
    with pytest.raises(ValueError, match="no committed"):
        committed.read_table(spark, out, "aggregates")
    write(spark, out, 0)
    write(spark, out, 1, commit=False)  # it died before the commit: one table may be whole, another not
    assert seen(spark, out) == seen(spark, out, "alerts") == {0}
    write(spark, out, 1)
    assert seen(spark, out) == seen(spark, out, "alerts") == {0, 1}
    assert sorted(n for n in os.listdir(f"{out}/_commits") if not n.endswith(".crc")) == ["batch-0", "batch-1"]


def test_compaction_keeps_all_rows_in_few_files(spark, tmp_path):
    out = str(tmp_path)
    for batch in range(6):
        write(spark, out, batch)
    write(spark, out, 6, commit=False)
    before = rows_of(committed.read_table(spark, out, "aggregates"))
    assert committed.compact(spark, out) == (0, 5)
    assert rows_of(committed.read_table(spark, out, "aggregates").select("customer_id", "window_start", "b", "i")) == before
    assert committed.drop_compacted(spark, out) == 12
    assert files(out, "aggregates") <= 6 + 4  # a file for each customer and day, and those of the dead writer
    write(spark, out, 6)
    write(spark, out, 7)
    assert committed.compact(spark, out) == (6, 7) and committed.compact(spark, out) is None
    committed.drop_compacted(spark, out)
    assert seen(spark, out) == seen(spark, out, "alerts") == set(range(8))
    kept = committed.read_table(spark, out, "aggregates")
    assert dict(kept.dtypes)["customer_id"] == "string" and {r.customer_id for r in kept.collect()} == {"00", "01"}
    day = kept.where((F.col("customer_id") == "00"))
    assert "PartitionFilters: [isnotnull(customer_id" in day._jdf.queryExecution().executedPlan().toString()


def test_a_writer_that_dies_while_it_compacts_changes_nothing(spark, tmp_path):
    out = str(tmp_path)
    for batch in range(3):
        write(spark, out, batch)
    rows(spark, 99).write.parquet(f"{out}/aggregates/run=0-2/customer_id=x/day=2020-01-01")
    assert seen(spark, out) == {0, 1, 2}
    assert committed.compact(spark, out) == (0, 2) and seen(spark, out) == {0, 1, 2}


def test_a_stream_commits_and_repeats_nothing(spark, tmp_path):
    live = streams.stream_session(spark)
    data, out, cp = (f"{tmp_path}/{n}" for n in ("in", "out", "cp"))
    events = random_events(3, 90, 3, 0.3)
    write_parts(spark, events, data, 0, 90, 30)

    def run():
        streams.start_set_states(source(live, data), out, cp, trigger=ONCE).awaitTermination()

    run()
    assert committed.commits(spark, out).batches == (0, 1, 2)
    whole = rows_of(committed.read_table(spark, out, "aggregates"))
    # The checkpoint forgets the end of the last micro-batch, as after a crash behind the commit.
    for name in os.listdir(f"{cp}/commits"):
        if name.strip(".").startswith("2"):
            os.remove(f"{cp}/commits/{name}")
    run()
    assert rows_of(committed.read_table(spark, out, "aggregates")) == whole
    assert committed.read_table(spark, out, "aggregates").count() == 90
