"""Events: mentions, intensities, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hawkes
from ..operators.selection import utility
from .registry import query, read

EVENTS = "e AS (SELECT user_id AS key, epoch_us(ts) / 86400000000.0 AS day, event_id, event_type, ts FROM events)"


def events(spark, sf_dir):
    """key, day (in days of the epoch)."""
    day = F.unix_micros(F.col("ts").cast("timestamp")) / 86400000000.0
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), day.alias("day"), "event_id", "event_type", "ts", "value", "props")


@query(f"WITH {EVENTS} SELECT key, count(*) AS n, round(greatest(0.01, count(*) / greatest((SELECT max(day) - min(day) FROM e), 30.0)), 9) AS mu FROM e GROUP BY key")
def hawkes_base(spark, sf_dir):
    return hawkes.base_rate(events(spark, sf_dir)).select("key", "n", F.round("mu", 9).alias("mu"))


@query(f"""WITH {EVENTS}, t AS (SELECT max(day) AS upto, max(day) - min(day) AS span FROM e)
SELECT key, round(greatest(0.01, count(*) / greatest(max(span), 30.0)) + sum(0.5 * exp(-0.1 * (upto - day))), 6) AS intensity FROM e, t GROUP BY key""")
def hawkes_intensity(spark, sf_dir):
    """At the last event of all."""
    e = events(spark, sf_dir).select("key", "day")
    at = e.agg(F.max("day")).first()[0]
    return hawkes.intensity(e, at if at is not None else 0.0).select("key", F.round("intensity", 6).alias("intensity"))


@query(f"WITH {EVENTS} SELECT a.key, a.event_id, round(sum(exp(-0.1 * (a.day - b.day))), 6) AS decayed FROM e a JOIN e b ON a.key = b.key AND b.day <= a.day GROUP BY 1, 2")
def hawkes_at_events(spark, sf_dir):
    """What a self join gives in quadratic time, from running sums in blocks of days."""
    e = events(spark, sf_dir)
    return e.select("key", "day", "event_id").join(hawkes.at_events(e.select("key", "day")), ["key", "day"]).select("key", "event_id", F.round("decayed", 6).alias("decayed"))


_A, _B = (",".join(map(str, g)) for g in hawkes.GRID)


@query(f"""WITH {EVENTS}, o AS (SELECT min(day) AS origin, max(day) - min(day) AS t FROM e), b AS (SELECT key, greatest(0.01, count(*) / greatest((SELECT t FROM o), 30.0)) AS mu FROM e GROUP BY key),
d AS (SELECT key, day - origin AS day, event_id, t FROM e, o), g AS (SELECT alpha, beta FROM (SELECT unnest([{_A}]) AS alpha), (SELECT unnest([{_B}]) AS beta)),
p AS (SELECT x.key, x.event_id, alpha, beta, sum(CASE WHEN y.day < x.day OR (y.day = x.day AND y.event_id < x.event_id) THEN exp(-beta * (x.day - y.day)) ELSE 0 END) AS a FROM d x JOIN d y ON x.key = y.key CROSS JOIN g GROUP BY ALL),
l AS (SELECT alpha, beta, sum(ln(mu + alpha * a)) AS s FROM p JOIN b USING (key) GROUP BY ALL),
c AS (SELECT alpha, beta, sum(1 - exp(-beta * (t - day))) AS s FROM d, g GROUP BY ALL)
SELECT l.alpha::DOUBLE AS alpha, l.beta::DOUBLE AS beta, round(l.s - (SELECT sum(mu) * max(t) FROM b, o) - l.alpha / l.beta * c.s, 3) AS ll FROM l JOIN c USING (alpha, beta) ORDER BY ll DESC, alpha, beta LIMIT 1""")
def hawkes_fit_grid(spark, sf_dir):
    return hawkes.fit(events(spark, sf_dir).select("key", "day")).select("alpha", "beta", F.round("ll", 3).alias("ll"))


@query(f"WITH {EVENTS} SELECT key, count(DISTINCT ts::DATE) AS mentions FROM e GROUP BY key")
def mention_dedupe(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("session", F.col("ts").cast("date"))
    return hawkes.mentions(e).groupBy("key").agg(F.count(F.lit(1)).alias("mentions"))


@query(f"""WITH {EVENTS}, u AS (SELECT key, max(day) AS last, count(*) AS n FROM e GROUP BY key), m AS (SELECT max(day) AS upto FROM e)
SELECT key, round(0.4 * exp(-(upto - last) / 30.0) + 0.3 * least(1.0, ln(1 + n) / ln(51.0)) + 0.2 * 0.5 + 0.1 * CASE WHEN key % 2 = 0 THEN 1.0 ELSE 0.6 END, 6) AS utility FROM u, m""")
def utility_rank(spark, sf_dir):
    e = events(spark, sf_dir)
    users = e.groupBy("key").agg(F.max("day").alias("last"), F.count(F.lit(1)).alias("n")).join(F.broadcast(e.agg(F.max("day").alias("at"))))
    return users.select("key", F.round(utility(F.col("at") - F.col("last"), F.col("n"), F.lit(0.5), F.when(F.col("key") % 2 == 0, 1.0).otherwise(0.6)), 6).alias("utility"))


@query("SELECT user_id, last(event_id ORDER BY ts, event_id) AS last_event, count(*) AS accesses, max(ts) AS last_access FROM events GROUP BY user_id")
def access_log(spark, sf_dir):
    """Reads are pure; accesses are counted from their log."""
    e = read(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"), F.count(F.lit(1)).alias("accesses"), F.max("ts").alias("last_access"))


@query("SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT time_bucket(INTERVAL 6 HOURS, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session""")
def events_session(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query(f"WITH {EVENTS}, m AS (SELECT key, day, event_id, max(day) OVER (PARTITION BY key) AS last FROM e) SELECT key, count(*) AS n, round(max(last), 6) AS last, round(sum(exp(-0.1 * (last - day))), 6) AS decayed FROM m GROUP BY key")
def stream_hawkes_state(spark, sf_dir):
    """The decayed state of each key from a stream of the events, which ends when all are read."""
    from ..streaming.stateful import run_hawkes

    return run_hawkes(spark, f"{sf_dir}/events.parquet")
