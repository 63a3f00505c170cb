"""Queries over history, coverage, datasets with labels and review threads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalogue import spec


@spec("churn_authors", "SELECT event_type AS dir, count(*) AS commits, count(DISTINCT user_id) AS authors, max(ts) AS last FROM events GROUP BY 1")
def churn_authors(t):
    by = t.events.groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return by.groupBy(F.col("event_type").alias("dir")).agg(F.sum("n").alias("commits"), F.count("*").alias("authors"), F.max("last").alias("last"))


@spec("churn_since", "SELECT u.user_id, count(e.event_id) AS churn FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN events e ON e.user_id = u.user_id AND e.ts >= TIMESTAMP '2024-01-20' GROUP BY 1")
def churn_since(t):
    return t.events.groupBy("user_id").agg(F.count_if(F.col("ts") >= F.lit("2024-01-20").cast("timestamp")).alias("churn"))


@spec("top_churn_dirs", "SELECT event_type || '/' || (user_id % 4) AS dir, count(*) AS changes FROM events GROUP BY 1 ORDER BY changes DESC, dir LIMIT 10")
def top_churn_dirs(t):
    return t.events.groupBy(F.concat("event_type", F.lit("/"), (F.col("user_id") % 4).cast("string")).alias("dir")).agg(F.count("*").alias("changes")).orderBy(F.desc("changes"), "dir").limit(10)


@spec("coverage_join", """WITH c AS (SELECT doc_id, n_chars, quality, round(100.0 * (doc_id % 97) / 97, 1) AS pct FROM documents JOIN labels USING (doc_id)) SELECT doc_id, pct, round(n_chars * (1 - pct / 100), 1) AS risk FROM c ORDER BY risk DESC, doc_id LIMIT 25""")
def coverage_join(t):
    c = t.documents.select("doc_id", "n_chars").join(t.labels.select("doc_id"), "doc_id").withColumn("pct", F.round(F.lit(100.0) * (F.col("doc_id") % 97) / 97, 1))
    return c.select("doc_id", "pct", F.round(F.col("n_chars") * (1 - F.col("pct") / 100), 1).alias("risk")).orderBy(F.desc("risk"), "doc_id").limit(25)


@spec("coverage_unmeasured", "SELECT doc_id, n_chars FROM documents ANTI JOIN labels USING (doc_id) ORDER BY n_chars DESC, doc_id LIMIT 10")
def coverage_unmeasured(t):
    return t.documents.select("doc_id", "n_chars").join(t.labels.select("doc_id"), "doc_id", "left_anti").orderBy(F.desc("n_chars"), "doc_id").limit(10)


@spec("label_coverage", "SELECT source, count(*) AS n, count(quality) AS quality_n, count(toxic) AS toxic_n, count(quality) > 0 AND count(quality) < count(*) AS partial, count(quality) < 30 AND count(quality) > 0 AS small_n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def label_coverage(t):
    both = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left")
    n, k = F.count("*"), F.count("quality")
    return both.groupBy("source").agg(n.alias("n"), k.alias("quality_n"), F.count("toxic").alias("toxic_n"), ((k > 0) & (k < n)).alias("partial"), ((k < 30) & (k > 0)).alias("small_n"))


@spec("json_field_tally", "WITH k AS (SELECT unnest(json_keys(props)) AS field, props FROM events) SELECT field, count(*) AS n, count(*) FILTER (json_extract_string(props, field) <> '') AS populated FROM k GROUP BY field")
def json_field_tally(t):
    pairs = t.events.select(F.explode(F.from_json("props", "map<string,string>")).alias("field", "value"))
    return pairs.groupBy("field").agg(F.count("*").alias("n"), F.count_if(F.col("value").isNotNull() & ~F.col("value").isin("", "[]", "{}")).alias("populated"))


@spec("first_n_cap", "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS total FROM events) SELECT user_id, event_id, n, total FROM r WHERE n <= 3")
def first_n_cap(t):
    w = Window.partitionBy("user_id")
    return t.events.select("user_id", "event_id", F.row_number().over(w.orderBy("ts", "event_id")).alias("n"), F.count("*").over(w).alias("total")).where("n <= 3")


@spec("lookback_flag", "SELECT event_id, coalesce(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), 0) AS recent FROM events")
def lookback_flag(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-20, 0)
    return t.events.select("event_id", F.max(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).over(w).alias("recent"))


@spec("commented_runs", """WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events)
SELECT user_id, event_type, min(n) AS first, count(*) AS length FROM r GROUP BY user_id, event_type, n - k HAVING count(*) >= 2""")
def commented_runs(t):
    r = t.events.select("user_id", "event_type", "ts", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("n"))
    k = r.withColumn("island", F.col("n") - F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")))
    return k.groupBy("user_id", "event_type", "island").agg(F.min("n").alias("first"), F.count("*").alias("length")).where("length >= 2").drop("island")


@spec("thread_order", "SELECT conv_id, turn, role, row_number() OVER (ORDER BY role <> 'user', conv_id, turn) AS place FROM conversations")
def thread_order(t):
    """Places of all turns: rows are ranked within ranges of conversations, and ranges go on from one to the next by counted sums."""
    from tessera.operators.order import places

    rows = t.conversations.select("conv_id", "turn", "role", (F.col("role") != "user").cast("int").alias("late"))
    return places(rows, ["late", "conv_id", "turn"], F.col("late"), F.floor(F.col("conv_id") / 256), "place").select("conv_id", "turn", "role", "place")


@spec("thread_summary", "SELECT role, count(*) AS comments, count(DISTINCT conv_id) AS threads, count(*) FILTER (text LIKE '%?%') AS questions, max(turn) AS longest FROM conversations GROUP BY role")
def thread_summary(t):
    return t.conversations.groupBy("role").agg(F.count("*").alias("comments"), F.countDistinct("conv_id").alias("threads"), F.count_if(F.col("text").contains("?")).alias("questions"), F.max("turn").alias("longest"))


@spec("bar_widths", "SELECT event_type, count(*) AS n, count(*) / max(count(*)) OVER () * 100 AS width FROM events GROUP BY 1")
def bar_widths(t):
    by = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    return by.crossJoin(F.broadcast(by.agg(F.max("n").alias("most")))).select("event_type", "n", (F.col("n") / F.col("most") * 100).alias("width"))


@spec("history_depth", "SELECT user_id, count(*) AS commits, date_diff('day', min(ts)::DATE, DATE '2024-02-01') AS age_days, count(*) >= 20 AS usable FROM events GROUP BY 1")
def history_depth(t):
    return t.events.groupBy("user_id").agg(F.count("*").alias("commits"), F.datediff(F.lit("2024-02-01").cast("date"), F.min("ts").cast("date")).cast("long").alias("age_days"), (F.count("*") >= 20).alias("usable"))
