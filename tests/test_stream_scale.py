"""Streams over many trucks and long logs."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from frostline.config import MICROS, Settings
from frostline.plans import catalog
from frostline.streaming import processors

START = 1_704_067_200_000_000


class Held:
    """A state variable of one truck."""

    value = None

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def readings(*values):
    """Readings (arrival_seq, seconds, temperature, target) of a truck."""
    columns = Row("customer_id", "truck_id", "arrival_seq", "event_us", "temperature", "target_temperature", "compressor_status")
    return iter([columns("c", "t", n, START + s * MICROS, x, g, "OFF") for n, s, x, g in values])


def started(processor):
    processor.init(Held())
    return processor


def sent(rows):
    """Results of rows of arrays, one after another."""
    return [dict(zip(r.__fields__[2:], v, strict=True)) for r in rows for v in zip(*r[2:], strict=True)]


def test_truck_windows_take_rows_and_send_arrays(monkeypatch):
    monkeypatch.setattr(processors, "CALL_ROWS", 2, raising=False)
    truck = started(processors.TruckWindows(Settings()))
    out = list(truck.handleInputRows(("c", "t"), readings((3, 20, -3.0, -18.0), (1, 0, -1.0, -18.0), (2, 10, -2.0, None)), None))
    assert [len(r.arrival_seq) for r in out] == [2, 1]
    rows = sent(out)
    assert [(r["arrival_seq"], r["sample_count"], r["sum_fixed"], r["previous_temperature"]) for r in rows] == [
        (1, 1, -1_000_000, None),
        (2, 2, -3_000_000, -1.0),
        (3, 3, -6_000_000, -2.0),
    ]
    assert [r["target_raw"] for r in rows] == [-18.0, None, -18.0]
    late = sent(truck.handleInputRows(("c", "t"), readings((4, 400, -4.0, -18.0), (5, 30, -5.0, -18.0)), None))
    assert [(r["late"], r["sample_count"], r["window_us"]) for r in late] == [(False, 1, START + 300 * MICROS), (True, 1, START + 300 * MICROS)]


def test_sliding_panes_take_rows_and_send_arrays():
    panes = started(processors.SlidingPanes(Settings(window_seconds=20, slide_seconds=10)))
    first = sent(panes.handleInputRows(("c", "t"), readings((1, 0, -1.0, -18.0), (2, 5, -2.0, None)), None))
    at = lambda s: START + s * MICROS
    assert [(r["window_us"], r["sample_count"], r["target_raw"]) for r in first] == [(at(-10), 2, -18.0), (at(0), 2, -18.0)]
    then = sent(panes.handleInputRows(("c", "t"), readings((3, 10, -9.0, -17.0)), None))
    assert [(r["window_us"], r["sample_count"], r["min_raw"], r["max_raw"], r["target_raw"]) for r in then] == [
        (at(0), 3, -9.0, -1.0, -17.0),
        (at(10), 1, -9.0, -9.0, -17.0),
    ]


@pytest.mark.parametrize("ids", [range(400), [0, 1, *range(200, 400)]])
def test_a_longer_log_has_more_files_and_the_same_micro_batches(spark, tmp_path, monkeypatch, ids):
    monkeypatch.setattr(catalog, "FILE_ROWS", 10, raising=False)
    spark.createDataFrame([(i, i % 3) for i in ids], "event_id BIGINT, user_id BIGINT").write.parquet(f"{tmp_path}/events.parquet")
    seen, files = {}, -(-len(ids) // 40)

    def look(batch, n):
        seen[n] = batch.collect()

    stream = catalog._log_stream(spark, str(tmp_path)).select("event_id", F.input_file_name().alias("file"))
    running = stream.writeStream.foreachBatch(look).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    running.awaitTermination()
    parts = {k: [i for i in ids if i // 100 == k] for k in range(4)}
    assert {k: sorted(r.event_id for r in rows) for k, rows in seen.items()} == parts
    assert {k: len({r.file for r in rows}) for k, rows in seen.items()} == {k: min(files, len(v)) for k, v in parts.items()}
