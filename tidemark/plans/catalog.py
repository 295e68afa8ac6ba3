"""Every query of the event-time engine by name, with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut, remove_at_end, shared_dir
from ..functions.windows import Sessions, Sliding, Tumbling, holds
from ..operators import aggregate as agg
from ..operators import heavy
from ..operators.dedup import mark_kept
from ..operators.policy import Policy, in_emission_order
from ..operators.watermark import BoundedLag, PercentileLag
from ..sources import arrivals as source
from ..streaming.replay import Replay

SIZE, STEP, LAG, GAP, GRACE, TTL = 21600, 3600, 1800, 21600, 43200, 600
PERCENTILE, LAST = 0.95, 200
CAPACITY, TOP = 64, 10

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- shared SQL ----

ARRIVALS_SQL = """
e AS (SELECT event_id, epoch_us(ts) // 1000000 AS event_time, event_type AS key, user_id, value FROM events),
sent AS (
  SELECT *, event_time + CASE WHEN (event_id * 7919 + 104729) % 1000 < 20 THEN 43200 + (event_id * 31) % 43200 ELSE (event_id * 1237) % 1801 END AS ingest_time, 0 AS is_retry FROM e
), arriving AS (
  SELECT * FROM sent UNION ALL BY NAME
  SELECT * REPLACE (ingest_time + 1 + (event_id * 53) % 1800 AS ingest_time, 1 AS is_retry) FROM sent WHERE (event_id * 3571 + 17) % 1000 < 30
), arrivals AS (SELECT *, row_number() OVER (ORDER BY ingest_time, event_id, is_retry) AS seq FROM arriving)"""


def _marked(lag: int, ttl: int | None) -> str:
    """Arrivals with watermark and kept, in SQL."""
    keep = "true" if ttl is None else f"row_number() OVER (PARTITION BY event_id ORDER BY seq) = 1 OR (wm_before - {ttl} >= 0 AND event_time < wm_before - {ttl})"
    return f"""{ARRIVALS_SQL},
timed AS (
  SELECT *, greatest(-1, max(event_time) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) - {lag}) AS wm,
    coalesce(greatest(-1, max(event_time) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {lag}), -1) AS wm_before FROM arrivals
), marked AS (SELECT *, {keep} AS kept FROM timed)"""


def _placed(lag: int, lateness: int, ttl: int | None, size: int, step: int, prefix: str = "") -> str:
    """Kept arrivals per window, and what fires when, in SQL. Counts and exact sums."""
    return f"""{_marked(lag, ttl)},
placed AS (
  SELECT *, window_end + {lateness} <= wm AS too_late, window_end <= wm AS late FROM (
    SELECT *, window_start + {size} AS window_end FROM (
      SELECT *, unnest(generate_series(greatest(((event_time - {size}) // {step} + 1) * {step}, 0), event_time // {step} * {step}, {step})) AS window_start FROM marked WHERE kept))
), accepted AS (SELECT * FROM placed WHERE NOT too_late),
ends AS (SELECT DISTINCT window_end FROM accepted),
moves AS (SELECT wm, min(seq) AS seq FROM marked WHERE kept GROUP BY wm),
crossings AS (
  SELECT e.window_end, m.seq AS cross_seq, m.wm AS cross_wm FROM ends e ASOF LEFT JOIN moves m ON m.wm >= e.window_end
), fired AS (
  SELECT a.*, CASE WHEN cross_seq IS NULL THEN NULL ELSE greatest(cross_seq, min(seq) OVER own) END AS fire_seq,
    CASE WHEN cross_seq IS NULL THEN NULL ELSE greatest(cross_wm, min(wm) OVER own) END AS fire_wm
  FROM accepted a JOIN crossings USING (window_end) WINDOW own AS (PARTITION BY key, window_start)
), results AS (
  SELECT key, window_start, window_end, count(*)::DOUBLE AS value, count(*) AS events, coalesce(any_value(fire_wm), (SELECT max(wm) FROM marked WHERE kept)) AS watermark, false AS revision, any_value(fire_seq) AS seq
  FROM fired WHERE fire_seq IS NULL OR seq <= fire_seq GROUP BY key, window_start, window_end
  UNION ALL
  SELECT key, window_start, window_end, n::DOUBLE, n, wm, true, seq FROM (
    SELECT *, count(*) OVER (PARTITION BY key, window_start ORDER BY seq ROWS UNBOUNDED PRECEDING) AS n FROM fired) WHERE seq > fire_seq
)"""


_VALUES = {
    "count": "count(*)::DOUBLE",
    "sum": "sum(value::DECIMAL(18,2))::DOUBLE",
    "mean": "sum(value::DECIMAL(18,2))::DOUBLE / count(*)::DOUBLE",
    "minmax": "max(value) - min(value)",
}


def _tumbling_sql(how: str) -> str:
    return f"""SELECT event_type AS key, t // {SIZE} * {SIZE} AS window_start, t // {SIZE} * {SIZE} + {SIZE} AS window_end, {_VALUES[how]} AS value, count(*) AS events
FROM (SELECT *, epoch_us(ts) // 1000000 AS t FROM events) GROUP BY 1, 2"""


def _sliding_sql(how: str) -> str:
    return f"""SELECT key, window_start, window_start + {SIZE} AS window_end, {_VALUES[how]} AS value, count(*) AS events FROM (
  SELECT event_type AS key, value, unnest(generate_series(greatest(((t - {SIZE}) // {STEP} + 1) * {STEP}, 0), t // {STEP} * {STEP}, {STEP})) AS window_start
  FROM (SELECT *, epoch_us(ts) // 1000000 AS t FROM events)) GROUP BY 1, 2"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as they happened: unique, without delays; only the columns that are used reach the scan."""
    return source.table(spark, sf_dir, "events").select("event_id", F.expr("unix_micros(cast(ts as timestamp)) div 1000000").alias("event_time"), F.col("event_type").alias("key"), "user_id", "value")


def _register_plain() -> None:
    for name, how in (("count", "count"), ("sum", "sum"), ("mean", "mean"), ("range", "minmax")):
        QUERIES[f"tumbling_{name}"] = lambda spark, sf_dir, how=how: agg.windowed(_events(spark, sf_dir), Tumbling(SIZE), how)
        ORACLES[f"tumbling_{name}"] = _tumbling_sql(how)
        QUERIES[f"pane_sliding_{name}"] = lambda spark, sf_dir, how=how: agg.windowed_by_panes(_events(spark, sf_dir), Sliding(SIZE, STEP), how)
        ORACLES[f"pane_sliding_{name}"] = _sliding_sql(how)


_register_plain()


@query(_sliding_sql("count"))
def sliding_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.windowed(_events(spark, sf_dir), Sliding(SIZE, STEP), "count")


@query(f"""SELECT t // {SIZE} * {SIZE} AS window_start, t // {SIZE} * {SIZE} + {SIZE} AS window_end, count(DISTINCT user_id)::DOUBLE AS value, count(*) AS events
FROM (SELECT *, epoch_us(ts) // 1000000 AS t FROM events) GROUP BY 1""")
def tumbling_distinct_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distinct users over all types: duplicates go within window and user first, so that sets are never held."""
    rows = _events(spark, sf_dir).withColumn("window_start", F.explode(Tumbling(SIZE).starts(F.col("event_time"))))
    users = rows.groupBy("window_start", "user_id").agg(F.count(F.lit(1)).alias("n"))
    done = users.groupBy("window_start").agg(F.count("user_id").cast("double").alias("value"), F.sum("n").alias("events"))
    return done.select("window_start", (F.col("window_start") + SIZE).alias("window_end"), "value", "events")


@query(f"""WITH t AS (SELECT user_id, epoch_us(ts) // 1000000 AS t FROM events),
marked AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= {GAP} THEN 0 ELSE 1 END AS fresh FROM t),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t) AS s FROM marked)
SELECT user_id, min(t) AS window_start, max(t) + {GAP} AS window_end, count(*)::DOUBLE AS value, count(*) AS events FROM numbered GROUP BY user_id, s""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.sessions(_events(spark, sf_dir), Sessions(GAP), "count", by=("user_id",))


@query(f"""WITH {ARRIVALS_SQL}, firsts AS (SELECT * FROM arrivals WHERE is_retry = 0),
a AS (SELECT event_time // {SIZE} * {SIZE} AS window_start, count(*) AS by_event FROM firsts GROUP BY 1),
b AS (SELECT ingest_time // {SIZE} * {SIZE} AS window_start, count(*) AS by_ingest FROM firsts GROUP BY 1)
SELECT window_start, coalesce(by_event, 0) AS by_event, coalesce(by_ingest, 0) AS by_ingest FROM a FULL JOIN b USING (window_start)""")
def eventtime_vs_ingesttime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per window by when things happened and by when they came: one pass, one shuffle."""
    firsts = source.arrivals(spark, sf_dir).where("is_retry = 0")
    starts = lambda c: F.element_at(Tumbling(SIZE).starts(F.col(c)), 1)
    both = F.array(F.struct(starts("event_time").alias("window_start"), F.lit(1).alias("e"), F.lit(0).alias("i")), F.struct(starts("ingest_time").alias("window_start"), F.lit(0).alias("e"), F.lit(1).alias("i")))
    return firsts.select(F.explode(both).alias("x")).groupBy("x.window_start").agg(F.sum("x.e").alias("by_event"), F.sum("x.i").alias("by_ingest"))


@query(f"""WITH {ARRIVALS_SQL}, kept AS (SELECT * FROM arrivals QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY seq) = 1)
SELECT key, count(*) AS events, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM kept GROUP BY key""")
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.unique_events(source.arrivals(spark, sf_dir)).groupBy("key").agg(F.count(F.lit(1)).alias("events"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))


@query(f"WITH {_marked(LAG, TTL)} SELECT seq, event_id, is_retry FROM marked WHERE kept")
def dedup_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_kept(BoundedLag(LAG).apply(source.arrivals(spark, sf_dir)), TTL).where("kept").select("seq", "event_id", "is_retry")


@query(f"WITH {_marked(LAG, None)} SELECT seq, event_time, wm FROM marked")
def bounded_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return BoundedLag(LAG).apply(source.arrivals(spark, sf_dir)).select("seq", "event_time", "wm")


@query(f"""WITH {ARRIVALS_SQL}, lagged AS (
  SELECT seq, event_time, list_sort(list(greatest(ingest_time - event_time, 0)) OVER (ORDER BY seq ROWS BETWEEN {LAST - 1} PRECEDING AND CURRENT ROW)) AS d,
    max(event_time) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS seen FROM arrivals
), estimated AS (SELECT *, greatest(d[least(floor({PERCENTILE}::DOUBLE * len(d))::BIGINT, len(d) - 1) + 1], 1)::BIGINT AS estimated_lag FROM lagged)
SELECT seq, event_time, estimated_lag, greatest(-1, max(seen - estimated_lag) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS wm FROM estimated""")
def percentile_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PercentileLag(PERCENTILE, LAST).apply(source.arrivals(spark, sf_dir)).select("seq", "event_time", "estimated_lag", "wm")


def _policy(lag: int = LAG, lateness: int = GRACE, ttl: int | None = TTL, windows=None, how: str = "count") -> Policy:
    return Policy(windows or Tumbling(SIZE), BoundedLag(lag), how, lateness, ttl)


_RESULTS = "key, window_start, window_end, value, events, watermark, revision, seq"


@query(f"WITH {_placed(LAG, GRACE, TTL, SIZE, SIZE)} SELECT {_RESULTS} FROM results")
def late_fires_and_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _policy().run(source.arrivals(spark, sf_dir)).results


@query(f"WITH {_placed(LAG, GRACE, TTL, SIZE, STEP)} SELECT {_RESULTS} FROM results")
def sliding_fires_and_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _policy(windows=Sliding(SIZE, STEP)).run(source.arrivals(spark, sf_dir)).results


@query(f"WITH {_placed(LAG, GRACE, TTL, SIZE, SIZE)} SELECT seq, event_time, key, value, event_id, ingest_time, window_start, window_end FROM placed WHERE too_late")
def side_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _policy().run(source.arrivals(spark, sf_dir)).side_output


@query(f"WITH {_placed(LAG, GRACE, TTL, SIZE, SIZE)}, last AS (SELECT *, row_number() OVER (PARTITION BY key, window_start ORDER BY seq DESC NULLS FIRST, revision DESC) AS r FROM results) SELECT window_start, window_end, sum(value)::DOUBLE AS total FROM last WHERE r = 1 GROUP BY 1, 2")
def totals_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.totals_by_window(_policy().run(source.arrivals(spark, sf_dir)).results)


#: Sessions of each user, arrival by arrival: one step of the recursion per arrival of a user. A state holds start, end, number,
#: the arrival that made it, and whether it grew out of one that had a result; a state that an arrival replaces ends there.
_SESSIONS_SQL = f"""WITH RECURSIVE {_marked(LAG, TTL).strip()},
own AS MATERIALIZED (SELECT user_id AS key, seq, event_time AS t, wm, wm_before, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS k FROM marked WHERE kept),
steps AS (
  SELECT DISTINCT key, 0::BIGINT AS k, NULL::BIGINT AS made, NULL::BIGINT AS s, NULL::BIGINT AS e, NULL::BIGINT AS n, NULL::BIGINT AS wm, NULL::BIGINT AS found, false AS again,
    []::BIGINT[] AS touched, []::STRUCT(s BIGINT, e BIGINT, n BIGINT, made BIGINT, again BOOLEAN)[] AS held FROM own
  UNION ALL
  SELECT key, k, seq, s, e, n, wm, wm_before, again, list_transform(hit, lambda x: x.made), list_append(list_filter(alive, lambda x: NOT list_contains(list_transform(hit, lambda y: y.made), x.made)), {{'s': s, 'e': e, 'n': n, 'made': seq, 'again': again}})
  FROM (
    SELECT *, least(t, coalesce(list_min(list_transform(hit, lambda x: x.s)), t)) AS s, greatest(t + {GAP}, coalesce(list_max(list_transform(hit, lambda x: x.e)), 0)) AS e,
      (1 + coalesce(list_sum(list_transform(hit, lambda x: x.n)), 0))::BIGINT AS n, len(list_filter(hit, lambda x: x.again OR x.e <= wm_before)) > 0 AS again
    FROM (SELECT *, list_filter(alive, lambda x: x.s <= t + {GAP} AND t <= x.e) AS hit
      FROM (SELECT o.*, list_filter(steps.held, lambda x: x.e + {GRACE} > o.wm_before) AS alive FROM steps JOIN own o ON o.key = steps.key AND o.k = steps.k + 1)))
), states AS (SELECT * FROM steps WHERE k > 0),
replaced AS (SELECT key, unnest(touched) AS made, found AS gone FROM states),
ends AS (SELECT DISTINCT e FROM states), moves AS (SELECT wm, min(seq) AS seq FROM marked WHERE kept GROUP BY wm),
crossings AS (SELECT x.e, m.seq AS cross_seq, m.wm AS cross_wm FROM ends x ASOF LEFT JOIN moves m ON m.wm >= x.e)"""


@query(f"""{_SESSIONS_SQL}
SELECT key, s AS window_start, e AS window_end, n::DOUBLE AS value, n AS events, CASE WHEN e <= wm THEN wm ELSE coalesce(cross_wm, (SELECT max(wm) FROM marked WHERE kept)) END AS watermark,
  again AS revision, CASE WHEN e <= wm THEN made ELSE cross_seq END AS seq
FROM states LEFT JOIN replaced USING (key, made) JOIN crossings USING (e) WHERE e <= wm OR gone IS NULL OR e <= gone""")
def sessions_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users as arrivals come: first results, and revisions where a late arrival extends or joins them."""
    rows = source.arrivals(spark, sf_dir).withColumn("key", F.col("user_id"))
    return Policy(Sessions(GAP), BoundedLag(LAG), "count", GRACE, TTL).run(rows).results.drop("replaces")


LATENESSES, LAGS = (0, 21600, 43200, 86400), (0, 600, 1800, 86400)
_COUNTS = "count(*) FILTER (NOT too_late)::BIGINT AS accepted, count(*) FILTER (late AND NOT too_late)::BIGINT AS late_but_accepted, count(*) FILTER (too_late)::BIGINT AS dropped_too_late"


def _sweep(spark: SparkSession, sf_dir: str, name: str, settings: list[tuple[int, int, int]]) -> DataFrame:
    """Counts per setting (its number, lag, lateness): the arrivals are read, numbered and placed once for all settings."""
    placed = _policy(0, 0, None).run(source.arrivals(spark, sf_dir).where("is_retry = 0")).placed.select("window_end", F.col("wm").alias("seen"))
    each = placed.withColumn("s", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(lag).alias("lag"), F.lit(grace).alias("grace")) for n, lag, grace in settings])))
    wm = F.greatest(F.lit(-1).cast("long"), F.col("seen") - F.col("s.lag"))
    late, too_late = F.col("window_end") <= wm, F.col("window_end") + F.col("s.grace") <= wm
    counts = each.groupBy(F.col("s.n").alias(name)).agg(
        F.count(F.when(~too_late, 1)).alias("accepted"), F.count(F.when(late & ~too_late, 1)).alias("late_but_accepted"), F.count(F.when(too_late, 1)).alias("dropped_too_late")
    )
    return counts.withColumn(name, F.col(name).cast("long"))


def _sweep_sql(name: str, settings: list[tuple[int, int, int]]) -> str:
    values = ", ".join(f"({n}, {lag}, {grace})" for n, lag, grace in settings)
    return f"""WITH {ARRIVALS_SQL}, seen AS (SELECT event_time // {SIZE} * {SIZE} + {SIZE} AS window_end, max(event_time) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS seen FROM arrivals WHERE is_retry = 0),
placed AS (SELECT n, window_end <= greatest(-1, seen - lag) AS late, window_end + grace <= greatest(-1, seen - lag) AS too_late FROM seen, (VALUES {values}) AS s(n, lag, grace))
SELECT n::BIGINT AS {name}, {_COUNTS} FROM placed GROUP BY n"""


@query(_sweep_sql("lateness", [(x, LAG, x) for x in LATENESSES]))
def lateness_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sweep(spark, sf_dir, "lateness", [(x, LAG, x) for x in LATENESSES])


@query(_sweep_sql("lag", [(x, x, 0) for x in LAGS]))
def lag_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sweep(spark, sf_dir, "lag", [(x, x, 0) for x in LAGS])


@query(f"WITH {_placed(LAG, GRACE, TTL, SIZE, STEP)} SELECT {_RESULTS}, row_number() OVER (ORDER BY seq NULLS LAST, revision DESC, window_start, window_end, key) AS place FROM results")
def emission_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of sliding windows, from panes, numbered as they come out."""
    done = Policy(Sliding(SIZE, STEP), BoundedLag(LAG), "count", GRACE, TTL, panes=True).run(source.arrivals(spark, sf_dir))
    return in_emission_order(done.results)


@query(f"WITH {_placed(LAG, GRACE, TTL, SIZE, STEP)} SELECT {_RESULTS} FROM results")
def replay_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from two batches, each by an object of its own that knows the folder alone."""
    rows, folder = cut(source.arrivals(spark, sf_dir)), f"{shared_dir(spark).rstrip('/')}/replay-{uuid.uuid4().hex}"
    remove_at_end(spark, folder)
    n = rows.count()
    make = lambda: Replay(spark, _policy(windows=Sliding(SIZE, STEP)), folder)
    for i in range(2):
        make().process(rows.where(F.expr(f"(seq - 1) * 2 div {n}") == i), i)
    return make().results().unionByName(make().flushed())


@query(f"""WITH {_placed(LAG, GRACE, TTL, SIZE, STEP)}
SELECT count(*) FILTER (NOT too_late)::BIGINT AS updates_of_windows, count(DISTINCT seq) FILTER (NOT too_late)::BIGINT AS updates_of_panes FROM placed""")
def pane_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often an aggregate is updated, window by window and pane by pane."""
    rows = cut(source.arrivals(spark, sf_dir))
    one = lambda panes, name: Policy(Sliding(SIZE, STEP), BoundedLag(LAG), "count", GRACE, TTL, panes=panes).run(rows).stats.select(F.col("aggregator_updates").alias(name))
    return one(False, "updates_of_windows").join(F.broadcast(one(True, "updates_of_panes")))  # one row each


@query(f"""SELECT len(generate_series(greatest(((t - {SIZE}) // 5000 + 1) * 5000, 0), t // 5000 * 5000, 5000))::INTEGER AS windows, count(*) AS events, bool_and(t >= (t // 5000) * 5000) AS held
FROM (SELECT epoch_us(ts) // 1000000 AS t FROM events) GROUP BY 1""")
def multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many windows events lie where the step does not divide the size, and whether each of them holds its event."""
    windows = Sliding(SIZE, 5000)
    rows = _events(spark, sf_dir).withColumn("starts", windows.starts(F.col("event_time")))
    held = F.forall("starts", lambda s: holds(F.col("event_time"), s, s + windows.size))
    return rows.select(F.size("starts").alias("windows"), held.alias("held")).groupBy("windows").agg(F.count(F.lit(1)).alias("events"), F.min("held").alias("held"))


@query(f"""WITH {_placed(LAG, GRACE, TTL, SIZE, SIZE)},
gone AS (SELECT w.window_end, m.seq FROM ends w ASOF JOIN moves m ON m.wm >= w.window_end + {GRACE}),
born AS (SELECT key, window_end, min(seq) AS seq FROM accepted GROUP BY key, window_end),
steps AS (SELECT seq, 1 AS step FROM born UNION ALL SELECT gone.seq, -1 FROM born JOIN gone USING (window_end)),
held AS (SELECT sum(step) OVER (ORDER BY seq) AS n FROM (SELECT seq, sum(step) AS step FROM steps GROUP BY seq))
SELECT (SELECT count(*) FROM marked WHERE kept) AS processed, (SELECT count(*) FROM marked WHERE NOT kept) AS duplicates_dropped,
  (SELECT count(*) FROM marked, (SELECT max(wm) - {TTL} AS c FROM marked WHERE kept) WHERE kept AND c >= 0 AND event_time < c) AS dedup_expired,
  count(*) FILTER (late AND NOT too_late) AS late_but_accepted, count(*) FILTER (too_late) AS dropped_too_late,
  (SELECT count(*) FROM born) AS windows_fired, (SELECT count(*) FROM results WHERE revision) AS revisions,
  count(*) FILTER (NOT too_late) AS aggregator_updates, (SELECT coalesce(max(n), 0)::BIGINT FROM held) AS peak_state_entries FROM placed""")
def pipeline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _policy().run(source.arrivals(spark, sf_dir)).stats


@query(f"SELECT user_id AS key, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, user_id)::INTEGER AS rank FROM events GROUP BY user_id ORDER BY 2 DESC, 1 LIMIT {TOP}")
def exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy.exact_topk(_events(spark, sf_dir), TOP, "user_id")


# a user's rank in a law of 1/k over the hash of event_id: skewed keys that both engines derive alike
_ZIPF = "CAST(floor(exp((event_id * 48271 % 65537) / 65537.0 * ln(500.0))) AS BIGINT)"


@query(f"SELECT {_ZIPF} AS key, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, {_ZIPF})::INTEGER AS rank FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {TOP}")
def zipf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy.exact_topk(_events(spark, sf_dir).withColumn("zipf", F.expr(_ZIPF)), TOP, "zipf")


def _zipf_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(F.expr(f"CAST({_ZIPF} AS STRING)").alias("key"), F.col("event_id").alias("seq"))


#: The counters after each event: one step of the recursion per event.
_SKETCH_SQL = f"""WITH RECURSIVE stream AS MATERIALIZED (SELECT {_ZIPF}::VARCHAR AS key, row_number() OVER (ORDER BY event_id) AS k FROM events),
steps AS (
  SELECT 0::BIGINT AS k, []::STRUCT(c BIGINT, key VARCHAR, e BIGINT)[] AS held
  UNION ALL
  SELECT s.k, CASE WHEN len(list_filter(held, lambda x: x.key = s.key)) > 0 THEN list_transform(held, lambda x: CASE WHEN x.key = s.key THEN {{'c': x.c + 1, 'key': x.key, 'e': x.e}} ELSE x END)
    WHEN len(held) < {CAPACITY} THEN list_append(held, {{'c': 1::BIGINT, 'key': s.key, 'e': 0::BIGINT}})
    ELSE list_append(list_sort(held)[2:], {{'c': list_sort(held)[1].c + 1, 'key': s.key, 'e': list_sort(held)[1].c}}) END
  FROM steps JOIN stream s ON s.k = steps.k + 1
), sketch AS (SELECT x.key, x.c AS count, x.e AS error FROM (SELECT unnest(held) AS x FROM (SELECT held FROM steps ORDER BY k DESC LIMIT 1))),
counts AS (SELECT key, count(*) AS true_count FROM stream GROUP BY key)"""


@query(f"{_SKETCH_SQL} SELECT key, count, error, (SELECT count(*) FROM stream) AS total FROM sketch")
def space_saving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy.space_saving(_zipf_stream(spark, sf_dir), CAPACITY)


@query()
def mergeable_space_saving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy.mergeable_sketch(_zipf_stream(spark, sf_dir), CAPACITY)


@query(f"SELECT {_ZIPF}::VARCHAR AS key, count(*) AS true_count, true AS held, true AS within_bounds FROM events GROUP BY 1 HAVING count(*) * {CAPACITY} > (SELECT count(*) FROM events)")
def mergeable_space_saving_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a merged summary promises, whatever the parts were: a counter for every key above 1/capacity, and
    count - error <= true count <= count."""
    stream = _zipf_stream(spark, sf_dir)
    counts = stream.groupBy("key").agg(F.count(F.lit(1)).alias("true_count"))
    total = stream.agg(F.count(F.lit(1)).alias("n"))
    often = counts.join(F.broadcast(total)).where(F.col("true_count") * CAPACITY > F.col("n"))  # total: one row
    both = often.join(heavy.mergeable_sketch(stream, CAPACITY), "key", "left")
    within = (F.col("count") - F.col("error") <= F.col("true_count")) & (F.col("true_count") <= F.col("count"))
    return both.select("key", "true_count", F.col("count").isNotNull().alias("held"), F.coalesce(within, F.lit(False)).alias("within_bounds"))


@query(f"""{_SKETCH_SQL} SELECT count(*) FILTER (true_count > count OR count - error > true_count) AS keys_out_of_bounds,
  count(*) FILTER (true_count * {CAPACITY} > (SELECT count(*) FROM stream) AND count IS NULL) AS frequent_keys_missed FROM counts LEFT JOIN sketch USING (key)""")
def space_saving_guarantee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many counters break count - error <= true <= count, and how many keys above 1/capacity have none: none ever."""
    stream = _zipf_stream(spark, sf_dir)
    counts = stream.groupBy("key").agg(F.count(F.lit(1)).alias("true"))
    total = stream.agg(F.count(F.lit(1)).alias("n"))
    both = counts.join(heavy.space_saving(stream, CAPACITY), "key", "left").join(F.broadcast(total))  # total: one row
    wrong = (F.col("true") > F.col("count")) | (F.col("count") - F.col("error") > F.col("true"))
    return both.agg(F.count(F.when(wrong, 1)).alias("keys_out_of_bounds"), F.count(F.when((F.col("true") > F.col("n") / CAPACITY) & F.col("count").isNull(), 1)).alias("frequent_keys_missed"))


@query(f"""{_SKETCH_SQL}, top AS (SELECT * FROM sketch ORDER BY count DESC, key LIMIT {TOP})
SELECT key, count, error, (count - error) * {CAPACITY} >= (SELECT count(*) FROM stream) AS guaranteed FROM top""")
def space_saving_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketch's top keys, and which of them are surely frequent."""
    sketch = cut(heavy.space_saving(_zipf_stream(spark, sf_dir), CAPACITY))
    sure = heavy.guaranteed_top(sketch, CAPACITY, TOP).select("key", F.lit(True).alias("sure"))
    return heavy.top_of(sketch, TOP).join(F.broadcast(sure), "key", "left").select("key", "count", "error", F.coalesce("sure", F.lit(False)).alias("guaranteed"))  # TOP rows


@query(f"""{_SKETCH_SQL}, best AS (SELECT key FROM counts ORDER BY true_count DESC, key LIMIT {TOP}), seen AS (SELECT key, count FROM sketch ORDER BY count DESC, key LIMIT {TOP})
SELECT count(best.key) / (SELECT count(*) FROM best) AS overlap, max(abs(count - true_count) / true_count)::DOUBLE AS worst_relative_error, (SELECT count(*) FROM counts) AS distinct_keys
FROM seen JOIN counts USING (key) LEFT JOIN best USING (key)""")
def topk_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = _zipf_stream(spark, sf_dir)
    return heavy.topk_agreement(stream, heavy.space_saving(stream, CAPACITY), TOP)


@query(f"""WITH {ARRIVALS_SQL}, d AS (SELECT greatest(ingest_time - event_time, 0) AS delay FROM arrivals)
SELECT (SELECT count(*) FROM arrivals) AS arrivals, (SELECT count(DISTINCT event_id) FROM arrivals) AS unique_events,
  (SELECT count(*) - count(DISTINCT event_id) FROM arrivals) AS duplicates, list_sort(list(delay))[len(list(delay)) // 2 + 1] AS median_delay, max(delay) AS max_delay FROM d""")
def stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.summary(source.arrivals(spark, sf_dir))


@query(f"WITH {ARRIVALS_SQL} SELECT sum(value::DECIMAL(18,2))::DOUBLE AS total FROM arrivals WHERE is_retry = 0 AND key = 'purchase'")
def true_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.true_total(source.arrivals(spark, sf_dir), "purchase")
