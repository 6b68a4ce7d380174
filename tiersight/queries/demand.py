"""The event log: rollups, rankings, reports and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tiersight.operators import demand
from tiersight.operators.staging import shared_root
from tiersight.queries.base import Tables, query
from tiersight.streaming import demand as streams

LOG_SQL = """log AS (SELECT event_id, ts, user_id, ts::DATE AS day, CASE WHEN event_type = 'view' THEN 'place' ELSE event_type END AS kind, CASE WHEN user_id % 3 = 0 THEN '' ELSE json_extract_string(props, '$.k') END AS text, (user_id % 40)::VARCHAR AS code,
  event_type AS name, CASE WHEN user_id % 4 = 0 THEN 'ar' ELSE 'fr' END AS locale, CASE WHEN user_id % 5 < 4 THEN 'browser' ELSE 'api' END AS via, user_id % 10 = 0 AS bot, value > 140 AS named FROM events)"""
DAILY_SQL = f"""{LOG_SQL}, kept AS (SELECT day, kind, text FROM log WHERE text <> '' GROUP BY ALL HAVING max(named::INT) = 1 OR count(*) >= 3),
daily AS (SELECT l.day, l.kind, CASE WHEN k.text IS NOT NULL THEN l.text ELSE '' END AS text, code, name, locale, via, bot, count(*) AS n FROM log l LEFT JOIN kept k ON k.day = l.day AND k.kind = l.kind AND k.text = l.text GROUP BY ALL)"""


def log_of(events):
    user, kind = F.col("user_id"), F.col("event_type")
    return events.select(
        "event_id", "ts", "user_id", F.to_date("ts").alias("day"), F.when(kind == "view", "place").otherwise(kind).alias("kind"),
        F.when(user % 3 == 0, "").otherwise(F.get_json_object("props", "$.k")).alias("text"), (user % 40).cast("string").alias("code"), kind.alias("name"),
        F.when(user % 4 == 0, "ar").otherwise("fr").alias("locale"), F.when(user % 5 < 4, "browser").otherwise("api").alias("via"), (user % 10 == 0).alias("bot"), (F.col("value") > 140).alias("named"),
    )


@query(f"WITH {DAILY_SQL} SELECT * FROM daily")
def daily_rollup(spark, sf_dir):
    return demand.daily_counts(log_of(Tables(spark, sf_dir).events))


@query(f"WITH {DAILY_SQL} SELECT code, sum(n)::BIGINT AS n FROM daily WHERE kind = 'place' AND via = 'browser' AND NOT bot AND day >= (SELECT max(day) - 30 FROM daily) GROUP BY code HAVING sum(n) >= 5 ORDER BY n DESC, code LIMIT 100")
def most_looked_up(spark, sf_dir):
    daily = demand.daily_counts(log_of(Tables(spark, sf_dir).events))
    last = daily.agg(F.date_sub(F.max("day"), 30)).first()[0]
    return demand.ranking(daily, F.lit(last))


SORTED_SQL = """{0} AS (SELECT * REPLACE (CASE kind WHEN 'click' THEN 'search' WHEN 'error' THEN 'tool' WHEN 'purchase' THEN 'download' WHEN 'signup' THEN 'client' ELSE kind END AS kind) FROM {1})"""


@query(f"""WITH {DAILY_SQL}, {SORTED_SQL.format("d", "daily")}, {SORTED_SQL.format("e", "(SELECT *, event_id % 4 AS results FROM log)")}, since AS (SELECT max(day) - 20 AS since FROM log),
r AS (SELECT 'places' AS report, code AS value, n FROM d, since WHERE day >= since AND kind = 'place' AND NOT bot UNION ALL SELECT 'searches', text, n FROM d, since WHERE day >= since AND kind = 'search' AND NOT bot
UNION ALL SELECT 'nothing found', text, 1 FROM e, since WHERE day >= since AND kind = 'search' AND results = 0 AND NOT bot UNION ALL SELECT 'tools', name, n FROM d, since WHERE day >= since AND kind = 'tool'
UNION ALL SELECT 'clients', name, n FROM d, since WHERE day >= since AND kind = 'client' UNION ALL SELECT 'came from', via, n FROM d, since WHERE day >= since AND kind IN ('place', 'search', 'download') AND NOT bot
UNION ALL SELECT 'downloads', code, n FROM d, since WHERE day >= since AND kind = 'download' AND NOT bot), s AS (SELECT report, value, sum(n)::BIGINT AS n FROM r WHERE value <> '' GROUP BY ALL)
SELECT report, value, n FROM s QUALIFY report = 'came from' OR row_number() OVER (PARTITION BY report ORDER BY n DESC, value) <= 25""")
def demand_reports(spark, sf_dir):
    log = log_of(Tables(spark, sf_dir).events).withColumn("results", F.col("event_id") % 4)
    named = F.create_map(*[F.lit(x) for x in ("click", "search", "error", "tool", "purchase", "download", "signup", "client")])
    sort = lambda rows: rows.withColumn("kind", F.coalesce(named[F.col("kind")], F.col("kind")))
    since = F.lit(log.agg(F.date_sub(F.max("day"), 20)).first()[0])
    return demand.reports(sort(demand.daily_counts(log)), sort(log), since)


@query(f"WITH {LOG_SQL} SELECT day, count(*) AS n FROM log WHERE day >= (SELECT max(day) - 20 FROM log) GROUP BY 1")
def retention(spark, sf_dir):
    log = log_of(Tables(spark, sf_dir).events)
    today = F.lit(log.agg(F.max("day")).first()[0])
    return demand.pruned(log, today, 20).groupBy("day").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT user_id % 60 AS place, (floor(value)::INT % 4)::VARCHAR AS name, event_type || (event_id % 2) AS spelling, user_id AS visitor, ts::DATE AS day, (user_id % 7) / 2.0::DOUBLE AS distance FROM events),
once AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY place, name, visitor ORDER BY day, spelling, distance) = 1), few AS (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY visitor, day ORDER BY place, name) <= 2),
c AS (SELECT place, name, count(DISTINCT visitor) AS votes, min(distance) AS distance, arg_min(spelling, day::VARCHAR || spelling) AS spelling FROM few WHERE distance <= 2 AND place NOT IN (SELECT DISTINCT user_id % 60 FROM events WHERE user_id % 60 < 9) GROUP BY ALL HAVING count(DISTINCT visitor) >= 2)
SELECT place, name, spelling, votes FROM c QUALIFY row_number() OVER (PARTITION BY place ORDER BY votes DESC, distance, name) = 1""")
def accepted_suggestions(spark, sf_dir):
    events = Tables(spark, sf_dir).events
    given = events.select((F.col("user_id") % 60).alias("place"), (F.floor("value").cast("int") % 4).cast("string").alias("name"), F.concat("event_type", (F.col("event_id") % 2).cast("string")).alias("spelling"), F.col("user_id").alias("visitor"), F.to_date("ts").alias("day"), ((F.col("user_id") % 7) / F.lit(2.0)).alias("distance"))
    known = given.select("place").distinct().where("place < 9")
    return demand.accepted(demand.limited(given, 2), known, 2.0)


@query("""SELECT event_type AS kind, sum(value::DECIMAL(18,2) * (1 + event_id % 5))::DOUBLE AS estimate, sum(1 + event_id % 5)::BIGINT AS rows FROM events GROUP BY 1""")
def sampled_estimates(spark, sf_dir):
    """Sums over a sampled log, each row counting for those it stands for."""
    weight = 1 + F.col("event_id") % 5
    return Tables(spark, sf_dir).events.groupBy(F.col("event_type").alias("kind")).agg(F.sum(F.col("value").cast("decimal(18,2)") * weight).cast("double").alias("estimate"), F.sum(weight).alias("rows"))


@query(f"WITH {DAILY_SQL} SELECT * FROM daily")
def streamed_rollup(spark, sf_dir):
    """The rollup by a stream over the log, as it stands after what is there now."""
    root = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    events = Tables(spark, sf_dir).events
    events.repartition(4, "event_id").write.parquet(f"{root}/arrived")
    log = log_of(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/arrived"))
    streams.rollup_stream(log, f"{root}/raw", f"{root}/daily", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/daily").select(*demand.KEY, "n")


@query("""WITH d AS (SELECT date_trunc('day', ts) AS day, event_type AS kind, count(*) AS n FROM events GROUP BY ALL) SELECT strftime(day, '%Y-%m-%d') AS day, kind, n FROM d""")
def day_windows(spark, sf_dir):
    """Tumbling days, as the stream counts them, over the whole log."""
    events = Tables(spark, sf_dir).events.withColumnRenamed("event_type", "kind")
    return events.groupBy(F.window("ts", "1 day"), "kind").agg(F.count("*").alias("n")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "kind", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark, sf_dir):
    sessions = streams.sessions(Tables(spark, sf_dir).events, gap="6 hours")
    return sessions.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
