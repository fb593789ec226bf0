"""Throughput tests: latency summaries, exact percentiles, rates and delivery statistics.

Latency samples need the run's key columns and `latency_ms DOUBLE, failed BOOLEAN, event_us BIGINT`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.config import MICROS, Settings
from frostline.functions import FIXED_UNITS, divide_rounded, fixed_point, mean_from_fixed, ratio
from frostline.operators.ordered import running_totals


def latency_percentiles(
    samples: DataFrame,
    by: list[str],
    percents: tuple[int, ...] = (50, 95, 99),
    digits: int = 3,
    cfg: Settings = Settings(),
) -> DataFrame:
    """Exact percentiles per run with linear interpolation at rank (n - 1) * p / 100.

    Samples without a latency count as none. The others are first counted per distinct value on the map side, so equal
    latencies cost one row. The ranks and the size of a run come from running totals over the distinct values, which
    split a run with very many of them (ordered.py), and each part picks its own ranks before parts meet.
    """
    timed = samples.where(F.col("latency_ms").isNotNull())
    values = timed.groupBy(*by, fixed_point(F.col("latency_ms")).alias("value")).agg(
        F.count(F.lit(1)).alias("copies")
    )
    placed = running_totals(values, by, "value", {"copies": "through"}, cfg.chunk_rows, {"copies": "n"})

    # Value at a zero-based rank: the distinct value whose copies cover that rank.
    def at(rank: Column) -> Column:
        covers = (rank >= F.col("through") - F.col("copies")) & (rank < F.col("through"))
        return F.max(F.when(covers, F.col("value")))

    picked = []
    for p in percents:
        scaled = (F.col("n") - 1) * p
        low = F.call_function("div", scaled, F.lit(100))
        high = F.call_function("div", scaled + 99, F.lit(100))
        picked += [at(low).alias(f"low{p}"), at(high).alias(f"high{p}")]
    ends = placed.groupBy(*by).agg(F.max("n").alias("samples"), *picked)

    unit = FIXED_UNITS // 10**digits * 100
    results = []
    for p in percents:
        low, high = F.col(f"low{p}"), F.col(f"high{p}")
        share = ((F.col("samples") - 1) * p) % 100
        results.append((divide_rounded(low * 100 + (high - low) * share, F.lit(unit)) / 10.0**digits).alias(f"p{p}"))
    return ends.select(*by, "samples", *results)


def latency_sketches(samples: DataFrame, by: list[str], k: int = 200) -> DataFrame:
    """One row per run: `timed` samples and a quantile sketch of their latencies, a few kilobytes whatever their number.

    Sketches of parts of a run, such as micro-batches, merge to the sketch of the run (`merge_sketches`), so they can be
    kept and added up. Ranks are off by 1.33 % at the default k with 99 % confidence, by less for a larger one.
    """
    return samples.where(F.col("latency_ms").isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("timed"), F.kll_sketch_agg_double("latency_ms", F.lit(k)).alias("sketch")
    )


def merge_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of each run as one. Partial merges happen before the shuffle."""
    return sketches.groupBy(*by).agg(F.sum("timed").alias("timed"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketched_percentiles(sketches: DataFrame, by: list[str], percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Percentiles read from the sketches: values of the run whose rank is near the wanted one."""
    read = [F.kll_sketch_get_quantile_double("sketch", F.lit(p / 100.0)).alias(f"p{p}") for p in percents]
    return sketches.select(*by, "timed", *read)


def throughput_summary(samples: DataFrame, by: list[str], cfg: Settings = Settings()) -> DataFrame:
    """One row per run: processed, errors, rate, mean and tail latency, failure rate.

    A sample without a latency counts as processed or failed, but not in the latencies; those of a run with none are 0.
    Sums are exact decimals, so that they hold for any number of samples.
    """
    base = samples.groupBy(*by).agg(
        F.count_if(~F.col("failed")).alias("processed"),
        F.count_if("failed").alias("error_count"),
        F.count(F.lit(1)).alias("all_samples"),
        F.sum(fixed_point(F.col("latency_ms")).cast("decimal(20,0)")).alias("total"),
        F.min("event_us").alias("started_us"),
        F.max("event_us").alias("completed_us"),
    )
    tails = latency_percentiles(samples, by, (95, 99), 3, cfg)
    elapsed_us = F.greatest(F.col("completed_us") - F.col("started_us"), F.lit(MICROS // 1000))
    none = F.lit(0.0)
    return base.join(tails, by, "left").select(
        *by,
        "processed",
        "error_count",
        ratio(elapsed_us, F.lit(MICROS), 3).alias("duration_seconds"),
        ratio(F.col("processed").cast("decimal(20,0)") * MICROS, elapsed_us, 2).alias("actual_rate"),
        F.coalesce(mean_from_fixed(F.col("total"), F.col("samples"), 3), none).alias("average_latency_ms"),
        F.coalesce("p95", none).alias("p95_latency_ms"),
        F.coalesce("p99", none).alias("p99_latency_ms"),
        ratio(F.col("error_count").cast("decimal(20,0)"), F.col("all_samples"), 6).alias("failure_rate"),
        "started_us",
        "completed_us",
        F.lit("COMPLETED").alias("status"),
    )


# Upper bounds of the latency histogram, in seconds.
LATENCY_BOUNDS = (0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0)


def latency_histogram(samples: DataFrame) -> DataFrame:
    """Cumulative counts per upper bound in seconds, `+Inf` last. One pass, one row of counters, then unpivoted.

    A sample without a latency is in no bucket.
    """
    seconds = F.col("latency_ms") / 1000.0
    labels = [*(str(b) for b in LATENCY_BOUNDS), "+Inf"]
    counters = [F.count_if(seconds <= b).alias(f"b{i}") for i, b in enumerate(LATENCY_BOUNDS)]
    counters.append(F.count("latency_ms").alias(f"b{len(LATENCY_BOUNDS)}"))
    cells = [v for i, label in enumerate(labels) for v in (F.lit(label), F.col(f"b{i}"))]
    return samples.agg(*counters).select(F.stack(F.lit(len(labels)), *cells).alias("le", "samples"))


def delivery_stats(reports: DataFrame, window_seconds: int = 5, cfg: Settings = Settings()) -> DataFrame:
    """Producer statistics at the end of every window: totals so far, delivery percentage, current and overall rate.

    Reports need `topic, event_us, delivered BOOLEAN`. The totals run over windows, not over reports.
    """
    width = window_seconds * MICROS
    windows = reports.groupBy("topic", F.call_function("div", F.col("event_us"), F.lit(width)).alias("slot")).agg(
        F.count(F.lit(1)).alias("sent"), F.count_if("delivered").alias("ok")
    )
    begun = windows.groupBy("topic").agg(F.min("slot").alias("first_slot"))
    totals = running_totals(windows, ["topic"], "slot", {"sent": "published", "ok": "delivered"}, cfg.chunk_rows)
    lasted = (F.col("slot") - F.col("first_slot") + 1) * window_seconds
    return totals.join(begun, "topic").select(
        "topic",
        (F.col("slot") * window_seconds).alias("window_start"),
        "published",
        "delivered",
        (F.col("published") - F.col("delivered")).alias("errors"),
        ratio(F.col("delivered") * 100, F.col("published"), 2).alias("delivery_percent"),
        ratio(F.col("sent"), F.lit(window_seconds), 1).alias("current_rate"),
        ratio(F.col("published"), lasted, 1).alias("overall_rate"),
    )


def throughput_overview(telemetry: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Events per second: newest window, average over windows with data, and peak."""
    slots = telemetry.groupBy(F.call_function("div", F.col("event_us"), F.lit(cfg.window_us)).alias("slot")).agg(
        F.count(F.lit(1)).alias("n")
    )
    seconds = F.lit(cfg.window_seconds)
    return slots.agg(
        ratio(F.max_by("n", "slot"), seconds, 3).alias("current"),
        ratio(F.sum("n"), F.count(F.lit(1)) * seconds, 3).alias("average"),
        ratio(F.max("n"), seconds, 3).alias("peak"),
    )


def recent_tests(tests: DataFrame, limit: int = 20) -> DataFrame:
    """Newest tests first. Runs as a top-k, no global sort."""
    return tests.orderBy(F.col("started_us").desc(), F.col("id")).limit(limit)


def find_test(tests: DataFrame, test_id: str) -> DataFrame:
    """The test with this id; no rows means not found."""
    return tests.where(F.col("id") == test_id)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [
        df.agg(F.count(F.lit(1)).alias("records")).select(F.lit(name).alias("table_name"), "records")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)
