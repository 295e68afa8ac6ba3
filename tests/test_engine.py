"""Windows, aggregates, watermarks, sources, sketches and native streams by themselves."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.aggregates import AGGREGATES, aggregate, merge_parts
from tidemark.functions.prefix import number, running_max, running_sum
from tidemark.functions.windows import Sessions, Sliding, Tumbling, holds, pane_width, panes_of
from tidemark.operators import heavy
from tidemark.operators.aggregate import sessions, windowed, windowed_by_panes
from tidemark.operators.dedup import mark_kept
from tidemark.operators.watermark import BoundedLag, PercentileLag, watermark
from tidemark.sources import arrivals as source
from tidemark.streaming import native


def timed(spark, *times, key="k"):
    return spark.createDataFrame([(t, key, float(i)) for i, t in enumerate(times)], "event_time long, key string, value double")


def test_windows(spark):
    starts = lambda w, *ts: [r[0] for r in spark.createDataFrame([(t,) for t in ts], "t long").select(w.starts(F.col("t"))).collect()]
    assert starts(Tumbling(60), 59, 60) == [[0], [60]]
    assert starts(Sliding(60, 10), 0, 7, 500) == [[0], [0], [450, 460, 470, 480, 490, 500]]
    assert [len(x) for x in starts(Sliding(60, 25), 500, 524)] == [3, 2]
    assert Sliding(60, 10).multiplicity == 6 and Sliding(60, 25).multiplicity == 3
    assert pane_width(60, 10) == 10 and pane_width(60, 25) == 5 and panes_of(0, 20, 5) == [(0, 5), (5, 10), (10, 15), (15, 20)]
    inside = spark.createDataFrame([(5, 0, 60), (60, 0, 60)], "t long, window_start long, window_end long").select(holds(F.col("t")))
    assert [r[0] for r in inside.collect()] == [True, False]


@pytest.mark.parametrize("make,text", [(lambda: Tumbling(0), "positive"), (lambda: Sliding(10, 60), "gaps"), (lambda: Sessions(0), "positive"), (lambda: panes_of(60, 60, 5), "empty or inverted"), (lambda: panes_of(0, 61, 5), "tile"), (lambda: aggregate("median"), "unknown"), (lambda: merge_parts([], ["key"], "sum"), "nothing to merge"), (lambda: watermark("other"), "unknown"), (lambda: heavy.SpaceSaving(0), "capacity")])
def test_guards(make, text):
    with pytest.raises(ValueError, match=text):
        make()


@pytest.mark.parametrize("how", sorted(AGGREGATES))
def test_parts_of_parts_are_parts_of_all(spark, how):
    a, b = (spark.createDataFrame([(f"k{i % 5}", float(i * s)) for i in range(n)], "key string, value double") for n, s in ((7, 1), (8, -1)))
    agg, none = aggregate(how), F.lit(0).alias("all")
    part = lambda df: df.groupBy(none).agg(*agg.of_rows())
    merged = merge_parts([part(a), part(b)], ["all"], agg).select(agg.value()).first()[0]
    assert merged == pytest.approx(part(a.unionByName(b)).select(agg.value()).first()[0])


def test_merged_means_are_weighted_and_nothing_is_zero(spark):
    a, b = (spark.createDataFrame([("k", x) for x in v], "key string, value double") for v in ([1.0, 2.0, 3.0], [100.0]))
    agg = aggregate("mean")
    assert merge_parts([x.groupBy("key").agg(*agg.of_rows()) for x in (a, b)], ["key"], agg).select(agg.value()).first()[0] == 26.5
    for how in ("mean", "minmax", "sum", "count"):
        assert a.limit(0).agg(*aggregate(how).of_rows()).select(aggregate(how).value()).first()[0] == 0.0


def test_sums_of_small_large_and_odd_values(spark):
    total = lambda how, *v: windowed(spark.createDataFrame([(1, "k", x) for x in v], "event_time long, key string, value double"), Tumbling(60), how).first().value
    assert total("sum", 0.004, 0.004) == 0.008 and total("sum", 1e-6, 2e-6) == pytest.approx(3e-6, rel=1e-12)
    assert total("mean", 0.004, 0.004) == 0.004 and total("sum", 1e-14, 1e-14) == pytest.approx(2e-14)
    assert total("sum", 1e20, -3e15, 0.5) == pytest.approx(1e20 - 3e15) and total("sum", None, 2.5) == 2.5 and total("sum", None) == 0.0
    assert total("sum", *[0.1] * 10) == 1.0
    whole = spark.createDataFrame([(1, "k", 2**40), (2, "k", 1)], "event_time long, key string, value long")
    assert windowed(whole, Tumbling(60), "sum").first().value == 2**40 + 1


def test_panes_equal_windows(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(r.randint(0, 500), r.choice("ab"), r.randint(-900, 900) / 100) for _ in range(300)], "event_time long, key string, value double")
    for size, step in ((60, 10), (60, 25)):
        for how in ("count", "sum", "mean", "minmax", "distinct"):
            rows = lambda x: sorted(map(tuple, x.collect()))
            assert rows(windowed_by_panes(df, Sliding(size, step), how)) == rows(windowed(df, Sliding(size, step), how))
    with pytest.raises(ValueError, match="panes apply to sliding windows"):
        windowed_by_panes(df, Tumbling(60))


def test_sessions(spark):
    spans = lambda gap, *ts: sorted((r.window_start, r.window_end, r.events) for r in sessions(timed(spark, *ts), Sessions(gap)).collect())
    assert spans(100, 0, 150, 90) == [(0, 250, 3)]
    assert spans(60, 0, 60) == [(0, 120, 2)] and len(spans(60, 0, 61)) == 2
    assert len(spans(60, 0, 5, 1000, 1005, 5000)) == 3


def test_prefixes(spark):
    r = random.Random(2)
    values = [r.randint(-50, 50) for _ in range(200)]
    df = number(spark.createDataFrame([(i, v, i // 17) for i, v in enumerate(values)], "at long, v long, bucket long"), "bucket", ["at"])
    df = running_sum(running_max(running_max(df, "bucket", "seq", "v", "top"), "bucket", "seq", "v", "before", inclusive=False), "bucket", "seq", "v", "sum")
    for x in df.collect():
        assert x.seq == x["at"] + 1 and x.top == max(values[: x.seq]) and x.sum == sum(values[: x.seq]) and x.before == (max(values[: x["at"]]) if x["at"] else None)


def arriving(spark, rows):
    return spark.createDataFrame([(i, t, g, e, (i - 1) // 5) for i, (t, g, e) in enumerate(rows, 1)], "seq long, event_time long, ingest_time long, event_id long, bucket long")


def test_watermarks(spark):
    got = [r.wm for r in BoundedLag(10).apply(arriving(spark, [(1000, 1000, 1), (5, 1001, 2)])).orderBy("seq").collect()]
    assert got == [990, 990]
    r = random.Random(3)
    rows = [(t := i * 2, t + r.choice([0, 1, 2, 30]), i) for i in range(120)]
    want, delays, seen, wm = [], [], -1, -1
    for t, g, _ in rows:
        delays.append(g - t)
        last = sorted(delays[-7:])
        lag = max(last[min(int(0.8 * len(last)), len(last) - 1)], 3)
        seen, wm = max(seen, t), max(wm, max(seen, t) - lag)
        want.append((lag, wm))
    for per_task in (7, 20_000):
        got = PercentileLag(0.8, 7, 3, per_task).apply(arriving(spark, rows)).orderBy("seq").collect()
        assert [(x.estimated_lag, x.wm) for x in got] == want


def test_ids_are_forgotten(spark):
    rows = [(0, 0, 1), (0, 1, 1), (500, 500, 2), (0, 501, 1), (100, 502, None), (100, 503, None)]
    kept = lambda ttl: [x.kept for x in mark_kept(BoundedLag(0).apply(arriving(spark, rows)), ttl).orderBy("seq").collect()]
    assert kept(None) == [True] * 6 and kept(10_000) == [True, False, True, False, True, True] and kept(100) == [True, False, True, True, True, True]


def test_sources(spark):
    mixed = source.mixed_stream(spark, 2000, late_fraction=0.05, duplicate_fraction=0.2, seed=1).cache()
    got = source.summary(mixed).first()
    assert got.unique_events == 2000 and 300 < got.duplicates < 500 and got.max_delay > 400
    assert source.unique_events(mixed).count() == 2000 and 60 < mixed.where("is_late AND is_retry = 0").count() < 140
    assert source.checked(mixed).where("key = 'refund' AND value >= 0 OR key <> 'refund' AND value <= 0").count() == 0
    assert source.true_total(mixed, "refund").first()[0] < 0 < source.true_total(mixed, "search").first()[0]
    assert [x.seq for x in mixed.orderBy("ingest_time", "event_id", "is_retry").collect()] == list(range(1, mixed.count() + 1))
    with pytest.raises(ValueError, match="late_fraction"):
        source.mixed_stream(spark, late_fraction=1.0)
    acts = source.sessions_stream(spark, users=20).cache()
    assert sum(x.events for x in sessions(acts, Sessions(60)).collect()) == acts.count() > 60
    skew = source.STREAMS["skewed"](spark, 5000, 800).cache()
    assert skew.count() == 5000 and heavy.exact_topk(skew, 1).first()["key"] == "k00000"
    with pytest.raises(Exception, match="clocks disagree"):
        source.checked(spark.createDataFrame([(100, 50)], "event_time long, ingest_time long")).collect()


def test_space_saving(spark):
    s = heavy.SpaceSaving(2)
    for x in "aabc":
        s.observe(x)
    assert s.counters == {"a": [2, 0], "c": [2, 1]}
    t = heavy.SpaceSaving(8)
    for x in "abcdefghijabc":
        t.observe(x)
    assert heavy.SpaceSaving.restore(t.state()).state() == t.state()
    skew = source.skewed_stream(spark, 6000, 900, seed=2).cache()
    true = {r["key"]: r["count"] for r in skew.groupBy("key").count().collect()}
    for sketch in (heavy.space_saving(skew, 64), heavy.mergeable_sketch(skew.repartition(5), 64, fan_in=2)):
        rows = {r["key"]: r for r in sketch.collect()}
        assert all(r["count"] - r.error <= true[k] <= r["count"] for k, r in rows.items())
        assert {k for k, n in true.items() if n > 6000 / 64} <= rows.keys() and rows.keys() <= true.keys()
    sketch = heavy.space_saving(skew, 256)
    agreement = heavy.topk_agreement(skew, sketch, 10).first()
    assert agreement.overlap == 1.0 and agreement.worst_relative_error < 0.2 and agreement.distinct_keys == len(true)
    assert 0 < heavy.guaranteed_top(sketch, 256, 10).count() <= 10


def test_native_streams(spark, tmp_path):
    rows = [(i, i * 10 + 100, "a" if i % 3 else "b", i, 1.0, i * 10 + 100, 0) for i in range(100)] + [(5, 150, "a", 5, 1.0, 160, 1)]
    df = spark.createDataFrame(rows, native.SCHEMA)
    for i in range(3):
        df.where(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    unique = df.dropDuplicates(["event_id"])
    for name, run in (("windows", lambda s: native.windowed(s, Sliding(100, 50), 2000)), ("panes", lambda s: native.windowed_by_panes(s, Sliding(100, 50), 2000))):
        df.unionByName(spark.createDataFrame([(999, 100_000, "z", 0, 1.0, 100_000, 0), (998, 110_000, "z", 0, 1.0, 110_000, 0)], native.SCHEMA)).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{name}-in")
        for _ in range(2):  # the second run finds nothing new
            native.run(run(native.read(spark, f"{tmp_path}/{name}-in")), f"{tmp_path}/{name}", f"{tmp_path}/{name}-state")
        got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/{name}").where("key <> 'z'").collect()))
        assert got == sorted(map(tuple, windowed(df, Sliding(100, 50)).collect()))
    native.run(native.deduplicated(native.read(spark, f"{tmp_path}/in"), 100_000).drop("ts"), f"{tmp_path}/once", f"{tmp_path}/once-state")
    assert spark.read.parquet(f"{tmp_path}/once").count() == unique.count()
