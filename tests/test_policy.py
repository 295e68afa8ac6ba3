import random

import pytest
from pyspark.sql import functions as F

from tests import model
from tidemark.functions.windows import Sessions, Sliding, Tumbling
from tidemark.operators.aggregate import sessions as batch_sessions
from tidemark.operators.aggregate import totals_by_window
from tidemark.operators.policy import Policy, in_emission_order, report, tumbling_count
from tidemark.operators.watermark import BoundedLag, PercentileLag
from tidemark.operators.sessions import current
from tidemark.streaming.replay import Replay

SCHEMA = "seq long, event_time long, key string, value double, event_id long, ingest_time long, is_retry int, bucket long"


def stream(spark, rows):
    """rows: (event_time, key, event_id, ingest_time), in order of arrival."""
    return spark.createDataFrame([(i, t, k, 1.0, e, g, 0, i // 7) for i, (t, k, e, g) in enumerate(rows, 1)], SCHEMA)


def simple(spark, *times):
    return stream(spark, [(t, "k", i, t) for i, t in enumerate(times)])


def results(outcome):
    return sorted(((r.key, r.window_start, int(r.value), r.watermark, r.revision, r.seq) for r in outcome.results.collect()), key=str)


def draw(seed, n=120):
    r = random.Random(seed)
    rows, ident = [], 0
    for i in range(n):
        if rows and r.random() < 0.15:
            t, k, e, _ = r.choice(rows[-30:])
            rows.append((t, k, e, i * 3 + 1000))
        else:
            rows.append((max(0, i * 3 - (r.randint(0, 400) if r.random() < 0.1 else r.randint(0, 20))), r.choice("ab"), ident, i * 3 + 1000))
            ident += 1
    return rows


@pytest.mark.parametrize("seed,size,step,lag,lateness,ttl", [(1, 60, 60, 0, 0, None), (2, 60, 60, 10, 100, 60), (3, 60, 25, 5, 30, 0), (4, 30, 10, 20, 300, 600)])
def test_equals_the_sequential_model(spark, seed, size, step, lag, lateness, ttl):
    rows = draw(seed)
    want = model.policy(rows, size, step, lag, lateness, ttl)
    got = Policy(Sliding(size, step), BoundedLag(lag), "count", lateness, ttl).run(stream(spark, rows))
    assert results(got) == sorted(want["results"], key=str)
    assert sorted((r.seq, r.key, r.window_start) for r in got.side_output.collect()) == sorted(want["side"])
    assert got.stats.first().asDict() == want["stats"]


@pytest.mark.parametrize("size,step,how", [(60, 10, "sum"), (60, 25, "mean"), (60, 20, "distinct")])
def test_panes_give_the_same_with_fewer_updates(spark, size, step, how):
    rows = stream(spark, draw(7, 150)).withColumn("value", F.col("seq") / 100)
    plain, panes = (Policy(Sliding(size, step), BoundedLag(10), how, 100, 60, panes=p).run(rows) for p in (False, True))
    pick = lambda o: sorted(map(str, o.results.collect()))
    assert pick(panes) == pick(plain)
    a, b = plain.stats.first().asDict(), panes.stats.first().asDict()
    assert b.pop("aggregator_updates") * (size // step) * 0.9 < a.pop("aggregator_updates") and a == b
    with pytest.raises(ValueError, match="panes apply to sliding windows"):
        Policy(Tumbling(60), BoundedLag(0), panes=True)


def test_emission_order(spark):
    rows = [(10, "b"), (20, "a"), (200, "a"), (30, "b"), (31, "b"), (500, "c"), (40, "a")]
    done = Policy(Tumbling(60), BoundedLag(0), lateness=1000).run(stream(spark, [(t, k, i, t) for i, (t, k) in enumerate(rows)]))
    got = [(r.seq, r.key, r.window_start, r.revision) for r in in_emission_order(done.results).orderBy("place").collect()]
    assert got == [(3, "a", 0, False), (3, "b", 0, False), (4, "b", 0, True), (5, "b", 0, True), (6, "a", 180, False), (7, "a", 0, True), (None, "c", 480, False)]
    assert [r.place for r in in_emission_order(done.results).orderBy("place").collect()] == list(range(1, 8))


@pytest.mark.parametrize("how", ["count", "sum"])
def test_a_shrinking_lag_lets_an_arrival_end_its_own_window(spark, how):
    rows = [(100, "k", 1, 200), (130, "k", 2, 230), (170, "k", 3, 171), (172, "k", 4, 173), (110, "k", 5, 174), (300, "k", 6, 301)]
    for lateness in (0, 60, 1000):
        done = Policy(Sliding(60, 20), PercentileLag(0.5, 2, 1), how, lateness).run(stream(spark, rows))
        state, fired, out, wm, delays, latest = {}, set(), [], -1, [], 0
        for seq, (t, _, _, g) in enumerate(rows, 1):
            delays, latest = [*delays, g - t][-2:], max(latest, t)
            wm = max(wm, latest - max(sorted(delays)[min(int(0.5 * len(delays)), len(delays) - 1)], 1))
            for s in model.starts(t, 60, 20):
                if s + 60 + lateness > wm:
                    state[s] = state.get(s, 0) + 1
                    out += [(s, state[s], wm, True, seq)] if s in fired else []
            for s in sorted(state):
                if s not in fired and s + 60 <= wm:
                    fired.add(s)
                    out.append((s, state[s], wm, False, seq))
        out += [(s, n, wm, False, None) for s, n in state.items() if s not in fired]
        assert sorted(((r.window_start, int(r.value), r.watermark, r.revision, r.seq) for r in done.results.collect()), key=str) == sorted(out, key=str)


def session_results(outcome):
    return sorted(((r.key, r.window_start, r.window_end, int(r.value), r.watermark, r.revision, r.seq, sorted((x.window_start, x.window_end) for x in r.replaces)) for r in outcome.results.collect()), key=str)


@pytest.mark.parametrize("seed,gap,lag,lateness,ttl", [(1, 10, 0, 0, None), (2, 15, 10, 100, 60), (3, 4, 5, 30, 0), (4, 40, 20, 300, 600), (5, 7, 3, 1000, None)])
def test_sessions_equal_the_sequential_model(spark, seed, gap, lag, lateness, ttl):
    rows = draw(seed)
    want = model.sessions(rows, gap, lag, lateness, ttl)
    got = Policy(Sessions(gap), BoundedLag(lag), "count", lateness, ttl).run(stream(spark, rows))
    assert session_results(got) == sorted(want["results"], key=str)
    assert sorted((r.seq, r.key, r.window_start) for r in got.side_output.collect()) == sorted(want["side"])
    stats = got.stats.first()
    assert stats.peak_state_entries == want["peak"] and stats.dropped_too_late == len(want["side"])
    assert stats.windows_fired + stats.revisions == len(want["results"])
    # whatever is replaced, each arrival counts once in the results that stand
    assert sum(r.events for r in current(got.results).collect()) == stats.aggregator_updates == stats.processed - stats.dropped_too_late


def test_late_arrivals_bridge_sessions(spark):
    done = Policy(Sessions(100), BoundedLag(1000)).run(simple(spark, 0, 150, 90))
    assert session_results(done) == [("k", 0, 250, 3, -1, False, None, [])]
    # without grace the first session has gone when the bridge comes
    gone = Policy(Sessions(100), BoundedLag(0)).run(simple(spark, 0, 10, 150, 160, 90))
    assert session_results(gone) == sorted([("k", 0, 110, 2, 150, False, 3, []), ("k", 90, 260, 3, 160, False, None, [])], key=str)
    kept = Policy(Sessions(100), BoundedLag(0), lateness=500).run(simple(spark, 0, 10, 150, 160, 90))
    assert session_results(kept) == sorted([("k", 0, 110, 2, 150, False, 3, []), ("k", 0, 260, 5, 160, True, None, [(0, 110)])], key=str)
    assert [r.events for r in current(kept.results).collect()] == [5]
    bursts = Policy(Sessions(60), BoundedLag(0)).run(simple(spark, 0, 5, 1000, 1005, 5000))
    assert [x[1:4] for x in session_results(bursts)] == [(0, 65, 2), (1000, 1065, 2), (5000, 5060, 1)]
    again = Policy(Sessions(10), BoundedLag(0)).run(simple(spark, 5, 500, 5, 5))
    assert sorted((r.seq, r.window_start) for r in again.side_output.collect()) == [(3, 5), (4, 5)]
    assert Policy(Sessions(10), BoundedLag(0)).run(simple(spark).limit(0)).results.count() == 0


@pytest.mark.parametrize("how", ["sum", "mean", "minmax", "distinct"])
def test_sessions_take_any_aggregate(spark, how):
    rows = stream(spark, draw(9, 100)).withColumn("value", F.col("seq") / 8)
    done = Policy(Sessions(20), BoundedLag(10_000), how).run(rows).results
    pick = lambda df: sorted(map(str, df.select("key", "window_start", "window_end", "value", "events").collect()))
    assert pick(done) == pick(batch_sessions(rows, Sessions(20), how))


def test_ingest_domain_never_drops(spark):
    rows = draw(5)
    want = model.policy(rows, 60, 60, 0, 0, None, "ingest")
    got = Policy(Tumbling(60), BoundedLag(0), domain="ingest").run(stream(spark, rows))
    assert results(got) == sorted(want["results"], key=str) and got.side_output.count() == 0


def test_revision_within_grace(spark):
    got = tumbling_count(60, 0, lateness=60).run(simple(spark, 10, 20, 100, 30))
    assert results(got) == sorted([("k", 0, 2, 100, False, 3), ("k", 0, 3, 100, True, 4), ("k", 60, 1, 100, False, None)], key=str)
    assert {(r.window_start, r.total) for r in totals_by_window(got.results).collect()} == {(0, 3.0), (60, 1.0)}


def test_beyond_grace_goes_to_the_side(spark):
    got = tumbling_count(60, 0).run(simple(spark, 10, 20, 200, 30))
    assert [(r.seq, r.window_start) for r in got.side_output.collect()] == [(4, 0)]
    assert got.stats.first().dropped_too_late == 1 and "dropped too late 1" in report(got.stats)


def test_no_arrivals(spark):
    got = tumbling_count(60, 0, dedup_ttl=5).run(simple(spark).limit(0))
    assert got.results.count() == 0 and got.stats.first().processed == 0


def test_guards():
    with pytest.raises(ValueError, match="time domain"):
        Policy(Tumbling(60), BoundedLag(0), domain="other")
    with pytest.raises(ValueError, match="lateness"):
        Policy(Tumbling(60), BoundedLag(0), lateness=-1)
    with pytest.raises(ValueError, match="lag"):
        BoundedLag(-1)
    with pytest.raises(ValueError, match="percentile"):
        PercentileLag(0.3)


def naive(rows, windows, mark, lateness=0, ttl=None, domain="event"):
    """Counts per arrival for any watermark and domain, in plain Python: results and which arrivals are kept."""
    seen, state, fired, out, kept, delays, wm, latest = {}, {}, set(), [], [], [], -1, None
    for seq, (t, key, ident, g) in enumerate(rows, 1):
        at = t if domain == "event" else g
        if ttl is not None and ident in seen:
            continue
        if ttl is not None:
            seen[ident] = at
        kept.append(seq)
        latest = t if latest is None else max(latest, t)
        if isinstance(mark, PercentileLag):
            delays = [*delays, max(g - t, 0)][-mark.window :]
            lag = max(sorted(delays)[min(int(mark.percentile * len(delays)), len(delays) - 1)], mark.minimum_lag)
        else:
            lag = mark.lag
        wm = max(wm, latest - lag)
        for s in model.starts(at, windows.size, windows.step):
            if s + windows.size + lateness > wm:
                state[key, s] = state.get((key, s), 0) + 1
                out += [(key, s, state[key, s], wm, True, seq)] if (key, s) in fired else []
        for k in [k for k in state if k not in fired and k[1] + windows.size <= wm]:
            fired.add(k)
            out.append((*k, state[k], wm, False, seq))
        if ttl is not None and wm - ttl >= 0:
            seen = {i: x for i, x in seen.items() if x >= wm - ttl}
    return out + [(*k, n, wm, False, None) for k, n in state.items() if k not in fired], kept


@pytest.mark.parametrize("mark,ttl,domain", [(PercentileLag(0.8, 9, 3), 40, "event"), (PercentileLag(0.6, 5, 1), 0, "event"), (PercentileLag(0.9, 30, 2), 10_000, "event"), (BoundedLag(0), 30, "ingest"), (PercentileLag(0.7, 9, 1), 60, "ingest")])
def test_duplicates_under_any_watermark_and_domain(spark, mark, ttl, domain):
    rows = [(t, k, e, max(g - 1000, t)) for t, k, e, g in draw(11, 150)]
    want, kept = naive(rows, Sliding(60, 30), mark, 50, ttl, domain)
    got = Policy(Sliding(60, 30), mark, "count", 50, ttl, domain).run(stream(spark, rows))
    assert sorted(r.seq for r in got.marked.where("kept").collect()) == kept
    assert results(got) == sorted(want, key=str)


@pytest.mark.parametrize("ttl,mark,ids", [(40, BoundedLag(10), "long"), (40, BoundedLag(10), "string"), (None, PercentileLag(0.8, 9, 3), "long"), (None, PercentileLag(0.9, 200, 1), "long")])
def test_batches_give_what_one_run_gives_also_after_a_restart(spark, tmp_path, ttl, mark, ids):
    rows = draw(6, 90)
    policy = Policy(Sliding(60, 20), mark, "sum", 60, ttl)
    whole = stream(spark, rows)
    if ids == "string":  # as wide as each other, so that they sort as numbers do
        whole = whole.withColumn("event_id", F.format_string("%05d", "event_id"))
    want = policy.run(whole)
    for i in range(4):  # a new object each time: all state is in the folder; the second batch runs twice, the third is empty
        own = whole.where((F.col("seq") > 30 * min(i, 2)) & (F.col("seq") <= 30 * min(i, 2) + 30)) if i != 2 else whole.limit(0)
        for _ in range(2 if i == 1 else 1):
            Replay(spark, policy, str(tmp_path)).process(own.drop("seq", "bucket"), i)
    done = Replay(spark, policy, str(tmp_path))
    pick = lambda df: sorted(map(str, df.select("key", "window_start", "window_end", "value", "events", "watermark", "revision", "seq").collect()))
    assert pick(done.results().unionByName(done.flushed())) == pick(want.results)
    assert sorted(map(str, done.side_output().select("seq", "window_start").collect())) == sorted(map(str, want.side_output.select("seq", "window_start").collect()))
    assert done.stats().first().asDict() == want.stats.first().asDict()
    with pytest.raises(ValueError, match="policy"):
        Replay(spark, Policy(Sliding(60, 20), mark, "sum", 61, ttl), str(tmp_path)).process(whole.drop("seq", "bucket"), 9)


def test_what_batches_cannot_carry(spark, tmp_path):
    for policy in (Policy(Sessions(5), BoundedLag(0)), Policy(Tumbling(5), PercentileLag(), dedup_ttl=5), Policy(Tumbling(5), BoundedLag(1), dedup_ttl=5, domain="ingest")):
        with pytest.raises(ValueError, match="Policy.run"):
            Replay(spark, policy, str(tmp_path))
