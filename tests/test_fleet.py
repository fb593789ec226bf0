from frostline.config import Settings
from frostline.operators import fleet, lag, metrics, performance, reconcile, routes
from frostline.schemas import DRIVERS, OWNERS, TRIPS, TRUCKS, VEHICLES
from frostline.sources import tables

AS_OF = 1000.0


def vehicles(spark):
    path = [(40.70, -74.01), (40.706, -74.02), (40.7128, -74.006), (40.72, -73.99)]
    rows = [
        ("truck-31", "2024-03-05", "Coastal Loop", "Chilled", "Truck 31", 58, "moving", 40.7128, -74.006, path),
        ("truck-52", "2024-03-05", "Ridge Shuttle", "Chilled", "Truck 52", 41, "delayed", 40.75, -73.96, path[:1]),
        ("truck-7", "2024-03-04", "Valley Relay", "Fresh", "a truck 7", 62, "moving", 40.7, -73.9, []),
    ]
    return spark.createDataFrame(rows, VEHICLES)


def test_route_filter(spark):
    found = routes.route_filter(vehicles(spark), "TRUCK-31", "2024-03-05", "coastal loop", "chilled").collect()
    assert [r.id for r in found] == ["truck-31"]
    assert routes.route_filter(vehicles(spark)).count() == 3


def test_trips_and_lookup(spark):
    trips = routes.trips(vehicles(spark), AS_OF)
    (trip,) = routes.find_trip(trips, "trip-truck-31").collect()
    assert (trip.status, trip.speed_kmh, trip.current_location.lat) == ("IN_PROGRESS", 58, 40.7128)
    assert 3.9 < trip.distance_km < 4.2
    assert routes.find_trip(trips, "trip-missing").count() == 0
    assert {r.vehicle_id: r.distance_km for r in trips.collect()}["truck-52"] == 0.0


def test_route_points_are_a_minute_apart(spark):
    points = routes.route_points(vehicles(spark), AS_OF).where("id = 'truck-31'").orderBy("point").collect()
    assert [p.timestamp for p in points] == [820.0, 880.0, 940.0, 1000.0]


def test_route_summary_and_kpis(spark):
    summary = routes.route_summary(vehicles(spark))
    got = {r.id: (r.completion, r.thermal_variance, r.eta_minutes, r.alerts) for r in summary.collect()}
    assert got == {"truck-31": (98, 4.9, 8, 0), "truck-52": (58, 5.1, 24, 2), "truck-7": (76, 5.1, 8, 0)}
    (kpi,) = routes.fleet_kpis(summary).collect()
    assert (kpi.total_trucks, kpi.moving, kpi.delayed, kpi.average_speed, kpi.on_time_percent) == (3, 2, 1, 54, 67)
    (none,) = routes.fleet_kpis(summary.where("id = 'x'")).collect()
    assert tuple(none) == (0, 0, 0, 0, 0, 0.0, 0)


def test_search_and_sort(spark):
    summary = routes.route_summary(vehicles(spark))
    assert {r.id for r in routes.fleet_search(summary, " TRUCK-5 ").collect()} == {"truck-52"}
    assert {r.id for r in routes.fleet_search(summary, "", "moving").collect()} == {"truck-31", "truck-7"}
    order = {by: [r.id for r in routes.fleet_sorted(summary, by).collect()] for by in routes.SORTS}
    assert order["name"] == ["truck-7", "truck-31", "truck-52"]
    assert order["speed"] == ["truck-7", "truck-31", "truck-52"]
    assert order["eta"] == ["truck-31", "truck-7", "truck-52"]
    assert order["thermal"] == ["truck-52", "truck-7", "truck-31"]


def test_track_length_does_not_depend_on_chunks(spark):
    rows = [("v", i, 40.7 + (i * 7 % 50) / 1000, -74.0 + (i % 30) / 1000) for i in range(200)]
    points = spark.createDataFrame(rows, "vehicle_id STRING, seq BIGINT, lat DOUBLE, lng DOUBLE")
    lengths = {routes.route_distance(points, Settings(chunk_rows=c)).collect()[0].distance_km for c in (1, 9, 1000)}
    assert len(lengths) == 1 and lengths.pop() > 100


def fleet_data(spark):
    n = None
    return {
        "owners": spark.createDataFrame([(1, "Birch Haulage", n, n, n, n, "active", n, n)], OWNERS),
        "trucks": spark.createDataFrame([(1, 1, "FL-31", "v", "Maker", "M1", 2022, 18.5, "available", 1.0, n, n, n)], TRUCKS),
        "drivers": spark.createDataFrame([(1, 1, "Ola", "Brandt", "L", n, n, n, n, "active", n, n, n)], DRIVERS),
        "trips": spark.createDataFrame(
            [
                (i, 1, 1, 1, "Depot One", "Dock Two", n, 1.0, 48.4 + i, s, n, f"2024-03-1{i} 08:15:00", n, 1.0, 2.0, n, n, n)
                for i, s in [(1, "completed"), (2, "in_transit"), (3, "scheduled")]
            ],
            TRIPS,
        ),
    }


def test_plate_history(spark):
    t = fleet_data(spark)
    fact = fleet.trip_fact(t["trips"], t["trucks"], t["owners"], t["drivers"])
    rows = fleet.plate_history(fact, " fl-31 ").collect()
    assert [(r.date, r.status, r.distance) for r in rows] == [
        ("2024-03-13", "Scheduled", "51 km"),
        ("2024-03-12", "In Transit", "50 km"),
        ("2024-03-11", "Completed", "49 km"),
    ]
    assert (rows[0].owner, rows[0].driver, rows[0].last_seen) == ("Birch Haulage", "Ola Brandt", "2024-03-13 08:15:00")
    assert fleet.plate_history(fact, "FL-000").count() == 0
    assert fleet.first_trip(t["trips"]).collect()[0].trip_id == 1
    assert {r.table_name: r.records for r in performance.table_counts(t).collect()} == {"owners": 1, "trucks": 1, "drivers": 1, "trips": 3}


def test_fleet_tables_are_read_with_their_schema(spark, tmp_path):
    for name, df in fleet_data(spark).items():
        df.write.parquet(f"{tmp_path}/{name}")
    loaded = tables.load_fleet(spark, str(tmp_path))
    assert {n: d.count() for n, d in loaded.items()} == {"owners": 1, "trucks": 1, "drivers": 1, "trips": 3}


def test_lag(spark):
    latest = spark.createDataFrame([("t", p, 100 * (p + 1), [p + 1, 9] if p else []) for p in range(4)], "topic STRING, partition INT, latest BIGINT, replicas ARRAY<INT>")
    committed = spark.createDataFrame([("g", "t", 0, 40), ("g", "t", 1, -1), ("g", "t", 3, 500)], "consumer_group STRING, topic STRING, partition INT, committed BIGINT")
    pairs = spark.createDataFrame([("g", "t"), ("h", "t")], "consumer_group STRING, topic STRING")
    report = lag.lag_report(pairs, latest, committed)
    g = lag.find_group(report, "g").orderBy("partition").collect()
    assert [(r.current_offset, r.lag, r.broker) for r in g] == [(40, 60, None), (0, 200, 2), (0, 300, 3), (500, 0, 4)]
    summary = {r.consumer_group: r for r in lag.lag_summary(report).collect()}
    assert (summary["g"].total_lag, summary["g"].max_partition_lag, summary["g"].average_partition_lag) == (560, 300, 140.0)
    assert (summary["h"].total_lag, summary["h"].partition_status, summary["h"].total_status) == (1000, "healthy", "healthy")
    assert {r.consumer_group: (r.worker1_lag, r.worker2_lag) for r in lag.worker_lag(report).collect()}["g"] == (560, 0)
    members = spark.createDataFrame([("g", 1, [1, 2]), ("g", 2, None), ("g", 3, [])], "consumer_group STRING, member_id INT, assignment ARRAY<INT>")
    assert [tuple(r) for r in lag.group_assignments(members).collect()] == [("g", 3, 2)]
    groups = lag.group_union(spark, committed, Settings(lag_groups="g,worker"))
    assert [r.consumer_group for r in groups.collect()] == ["g", "worker"]


def test_dashboard_metrics(spark):
    rows = [("c", "a", 0, 10, -5.0), ("c", "a", 1, 20, -18.0), ("c", "b", 2, 900_000_001, -5.0)]
    telemetry = spark.createDataFrame(rows, "customer_id STRING, truck_id STRING, arrival_seq BIGINT, event_us BIGINT, temperature DOUBLE")
    got = {r.metric: r.value for r in metrics.dashboard_metrics(telemetry).collect()}
    assert got == {"active_trucks": 2.0, "events_per_second": 0.003, "uptime_percent": 50.0, "temperature_alerts": 1.0}
    assert [tuple(r) for r in metrics.events_by_customer(telemetry).collect()] == [("c", 3)]


def test_export_quotes_every_value(spark, tmp_path):
    rows = spark.createDataFrame([('a"b', None, 1.5)], "id STRING, note STRING, rate DOUBLE")
    fields = ("id", "note", "rate")
    assert tables.csv_lines(rows, fields).collect()[0].line == '"a""b","","1.5"'
    tables.export_rows(rows.coalesce(1), f"{tmp_path}/csv", fields)
    (part,) = (tmp_path / "csv").glob("part-*.csv")
    assert part.read_text().splitlines()[1] == '"a""b","","1.5"'
    tables.export_rows(rows, f"{tmp_path}/json", fields, "json")
    assert spark.read.json(f"{tmp_path}/json").collect()[0].id == 'a"b'


def test_results_are_appended_in_snake_case(spark, tmp_path):
    rows = spark.createDataFrame([("x", 1.0)], "id STRING, p95LatencyMs DOUBLE")
    for _ in range(2):
        tables.append_rows(tables.snake_case(rows), f"{tmp_path}/tests")
    saved = spark.read.parquet(f"{tmp_path}/tests")
    assert saved.columns == ["id", "p95_latency_ms"] and saved.count() == 2
    assert performance.find_test(saved, "missing").count() == 0


def test_an_empty_export_writes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "id STRING, n INT")
    for kind in ("csv", "json"):
        assert not tables.export_rows(rows.limit(0), f"{tmp_path}/{kind}", ("id", "n"), kind)
        assert not (tmp_path / kind).exists()
        assert tables.export_rows(rows, f"{tmp_path}/{kind}", ("id", "n"), kind) and (tmp_path / kind).exists()
        assert not tables.export_rows(rows.limit(0), f"{tmp_path}/{kind}", ("id", "n"), kind)
        assert len(spark.read.text(f"{tmp_path}/{kind}").collect()) >= 1


def test_groups_without_partitions_or_description(spark):
    groups = spark.createDataFrame([("a", "STABLE"), ("idle", "EMPTY")], "consumer_group STRING, state STRING")
    members = spark.createDataFrame([("a", "m1", [1, 2]), ("a", "m2", None)], "consumer_group STRING, member_id STRING, assignment ARRAY<INT>")
    report = spark.createDataFrame([("a", "t", 0, 5), ("b", "t", 0, 7)], "consumer_group STRING, topic STRING, partition INT, lag BIGINT")
    got = {r.consumer_group: tuple(r)[1:7] for r in lag.group_overview(groups, members, report).collect()}
    assert got == {"a": ("STABLE", 2, 2, 1, 5, 5), "b": ("unknown", 0, 0, 1, 7, 7), "idle": ("EMPTY", 0, 0, 0, 0, 0)}
    (empty,) = lag.lag_summary(report.limit(0), groups=groups.limit(1)).collect()
    assert (empty.total_lag, empty.average_partition_lag, empty.partition_status, empty.total_status) == (0, 0.0, "healthy", "healthy")


def test_only_buckets_that_differ_are_joined(spark):
    ids = [f"e{i}" for i in range(5000)]
    sent = spark.createDataFrame([(i,) for i in [*ids, "twice", "twice", None]], "event_id STRING")
    received = spark.createDataFrame([(i,) for i in ids if i not in ("e7", "e4000")] + [("twice",), ("extra",), (None,)], "event_id STRING")
    assert reconcile.changed_buckets(sent, sent).count() == 0
    assert reconcile.changed_buckets(sent, received).count() <= 4
    missing = reconcile.missing_events_by_checksum(sent, received)
    assert sorted(r.event_id for r in missing.collect()) == ["e4000", "e7"]
    plan = missing._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan
    assert reconcile.missing_events_by_checksum(sent, sent).count() == 0


def test_trips_by_truck_are_not_exchanged(spark, sf_dir):
    """A plate is resolved first; trips are read once, and a layout by truck spares the join its exchange."""
    from frostline.plans import adapters

    t = adapters.fleet_tables(spark, sf_dir)
    found = fleet.plate_trips(t["trips"], t["trucks"], t["owners"], t["drivers"], "fl-71")
    want = fleet.plate_history(fleet.trip_fact(t["trips"], t["trucks"], t["owners"], t["drivers"]), "fl-71")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("orders.parquet") == 1
    assert found.collect() == want.collect()
    spark.sql("drop table if exists trips_by_truck")
    fleet.write_trips(t["trips"], "trips_by_truck", 4)
    laid_out = spark.table("trips_by_truck")
    totals = laid_out.groupBy("truck_id").count()
    assert "Exchange" not in totals._jdf.queryExecution().executedPlan().toString()
    assert totals.agg({"count": "sum"}).first()[0] == t["trips"].count()
    spark.sql("drop table trips_by_truck")
