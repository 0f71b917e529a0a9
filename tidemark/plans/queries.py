"""Queries over the shared tables, each with SQL that another engine runs on the same files.

`events` stands for the observation stream (user_id as narrative or symbol, event_type as entity
or source), `pages` for addresses and page texts, `documents` for articles, `embeddings` for
title vectors, `orders` and `lineitem` for daily series. Doubles are rounded to six digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import clock, stats, text, vectors
from tidemark.operators.components import connected_components

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL if it has any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str | Column) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def r6(x: Column) -> Column:
    return F.round(x, 6)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("t", clock.window_of(F.col("ts")))


EV = "WITH e AS (SELECT *, CAST(floor(date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / CAST(9e8 AS DOUBLE)) AS BIGINT) AS t FROM events)"


def spine(e: DataFrame) -> DataFrame:
    """Every window from the first to the last, those without rows too."""
    return e.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo IS NOT NULL").select(F.explode(F.sequence("lo", "hi")).alias("t"))


@query(f"""{EV}, s AS (SELECT unnest(range((SELECT min(t) FROM e), (SELECT max(t) FROM e) + 1)) AS t),
c AS (SELECT t, count(*) AS n, count(DISTINCT user_id) AS u FROM e GROUP BY t)
SELECT s.t AS win, CAST(coalesce(n, 0) AS BIGINT) AS n_rows, CAST(coalesce(u, 0) AS BIGINT) AS n_users, n IS NULL AS missing FROM s LEFT JOIN c USING (t)""")
def window_ledger_dense(spark, sf_dir):
    """SCA-08, AGG-02, STR-04, JOIN-17: counts per window, empty windows flagged missing."""
    e = events(spark, sf_dir)
    c = e.groupBy("t").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("u"))
    return spine(e).join(c, "t", "left").select(F.col("t").alias("win"), F.coalesce("n", F.lit(0)).cast("long").alias("n_rows"), F.coalesce("u", F.lit(0)).cast("long").alias("n_users"), F.col("n").isNull().alias("missing"))


@query(f"""{EV}, v AS (SELECT t, (isodow(TIMESTAMP '2024-01-01' + to_seconds(t * 900)) - 1) * 24 + hour(TIMESTAMP '2024-01-01' + to_seconds(t * 900)) AS how, count(*) AS v FROM e GROUP BY t)
SELECT t AS win, CAST(how AS INTEGER) AS hour_of_week, CAST(v AS BIGINT) AS v, round(avg(v) OVER (PARTITION BY how ORDER BY t ROWS UNBOUNDED PRECEDING), 6) AS running_mean FROM v""")
def hour_of_week_profile(spark, sf_dir):
    """SCA-11, AGG-23: running mean of the window's volume in its hour of the week."""
    v = events(spark, sf_dir).groupBy("t").agg(F.count("*").alias("v")).withColumn("how", clock.hour_of_week(clock.window_start(F.col("t"))))
    mean = F.avg("v").over(W.partitionBy("how").orderBy("t").rowsBetween(W.unboundedPreceding, 0))
    return v.select(F.col("t").alias("win"), F.col("how").cast("int").alias("hour_of_week"), "v", r6(mean).alias("running_mean"))


@query(f"""{EV}, g AS (SELECT user_id, t, event_type, count(*) AS n FROM e GROUP BY ALL)
SELECT user_id, t AS win, CAST(255 * count(*) AS BIGINT) AS y255, CAST(255 * sum(n) AS BIGINT) AS m255 FROM g GROUP BY user_id, t""")
def attention_by_window(spark, sf_dir):
    """AGG-01, PF-01: attention of roots (first of a type in its window) and reach of all, in 255ths."""
    g = events(spark, sf_dir).groupBy("user_id", "t", "event_type").agg(F.count("*").alias("n"))
    return g.groupBy("user_id", "t").agg((255 * F.count("*")).cast("long").alias("y255"), (255 * F.sum("n")).cast("long").alias("m255")).withColumnRenamed("t", "win")


@query(f"""{EV}, d AS (SELECT event_type, t, count(*) AS df FROM e GROUP BY ALL), n AS (SELECT t, sum(df) AS n FROM d GROUP BY t),
a AS (SELECT event_type, t, coalesce(sum(df) OVER (PARTITION BY event_type ORDER BY t RANGE BETWEEN 672 PRECEDING AND 1 PRECEDING), 0) AS df FROM d),
b AS (SELECT t, coalesce(sum(n) OVER (ORDER BY t RANGE BETWEEN 672 PRECEDING AND 1 PRECEDING), 0) AS n FROM n)
SELECT event_type, a.t AS win, CAST(df AS BIGINT) AS df, CAST(n AS BIGINT) AS n, round(ln((n + 1) / (df + 1)) + 1, 6) AS idf FROM a JOIN b ON a.t = b.t""")
def causal_idf(spark, sf_dir):
    """AGG-04, MTH-01: document frequency of the week before, the current window left out."""
    d = events(spark, sf_dir).groupBy("event_type", "t").agg(F.count("*").alias("df"))
    before = lambda w: w.orderBy("t").rangeBetween(-672, -1)
    own = d.select("event_type", "t", F.coalesce(F.sum("df").over(before(W.partitionBy("event_type"))), F.lit(0)).alias("df"))
    # one row per window of time, whatever the number of events
    n = d.groupBy("t").agg(F.sum("df").alias("n")).select("t", F.coalesce(F.sum("n").over(before(W.partitionBy())), F.lit(0)).alias("n"))
    return own.join(n, "t").select("event_type", F.col("t").alias("win"), "df", "n", r6(stats.idf(F.col("n"), F.col("df"))).alias("idf"))


@query(f"""{EV}, v AS (SELECT t, count(*) AS v FROM e GROUP BY t), s AS (SELECT unnest(range((SELECT min(t) FROM e), (SELECT max(t) FROM e) + 1)) AS t),
d AS (SELECT s.t, coalesce(v, 0) AS v FROM s LEFT JOIN v USING (t)),
m AS (SELECT t, v, avg(v) OVER (ORDER BY t ROWS BETWEEN 672 PRECEDING AND 1 PRECEDING) AS l, avg(v) OVER (ORDER BY t ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS s, count(*) OVER (ORDER BY t ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS n FROM d)
SELECT t AS win, CAST(v AS BIGINT) AS v, round(CASE WHEN n < 24 THEN 0 ELSE l END, 6) AS week_mean, round(CASE WHEN n < 24 THEN 0 ELSE s END, 6) AS six_hour_mean, round(CASE WHEN n < 24 OR l = 0 THEN 0 ELSE s / l END, 6) AS ratio FROM m""")
def trailing_volume_ratio(spark, sf_dir):
    """WIN-05: means of the week and the six hours before a window, zero until 24 windows exist."""
    e = events(spark, sf_dir)
    d = spine(e).join(e.groupBy("t").agg(F.count("*").alias("v")), "t", "left").select("t", F.coalesce("v", F.lit(0)).alias("v"))
    w = W.orderBy("t")  # one row per window of time
    m = d.select("t", "v", F.avg("v").over(w.rowsBetween(-672, -1)).alias("l"), F.avg("v").over(w.rowsBetween(-24, -1)).alias("s"), F.count("*").over(w.rowsBetween(-24, -1)).alias("n"))
    ripe = lambda c: r6(F.when(F.col("n") < 24, 0.0).otherwise(c))
    return m.select(F.col("t").alias("win"), "v", ripe(F.col("l")).alias("week_mean"), ripe(F.col("s")).alias("six_hour_mean"), r6(F.when((F.col("n") < 24) | (F.col("l") == 0), 0.0).otherwise(F.col("s") / F.col("l"))).alias("ratio"))


@query("""WITH b AS (SELECT user_id, event_id, ts, value AS c, CAST(json_extract(props, '$.k') AS DOUBLE) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT *, c / nullif(lag(c) OVER w, 0) - 1 AS ret FROM b WINDOW w AS (PARTITION BY user_id ORDER BY i)),
s AS (SELECT *, count(*) OVER f AS n, list(ret) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 58 PRECEDING AND 1 PRECEDING) AS rs, avg(v) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 59 PRECEDING AND 1 PRECEDING) AS vm FROM r WINDOW f AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
z AS (SELECT *, list_avg(list_filter(rs, lambda x: x IS NOT NULL)) AS rm, list_stddev_pop(list_filter(rs, lambda x: x IS NOT NULL)) AS sd FROM s),
o AS (SELECT user_id, event_id, CASE WHEN n < 15 THEN 0.0 ELSE (ret - rm) / (sd + 1e-8) END AS z, CASE WHEN n < 15 THEN 1.0 ELSE v / (vm + 1) END AS q FROM z)
SELECT user_id, event_id, round(z, 6) AS return_z, round(q, 6) AS vol_ratio, abs(z) >= 4 AND q >= 3.5 AS is_anomaly FROM o""")
def bar_anomaly(spark, sf_dir):
    """WIN-06, STR-06: last return and volume of 60 bars against the earlier ones of them."""
    from tidemark.operators.observer import bar_alerts

    b = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    out = bar_alerts(b, symbol="user_id", order=["ts", "event_id"], close="value", volume="k")
    return out.select("user_id", "event_id", r6(F.col("return_z")).alias("return_z"), r6(F.col("vol_ratio")).alias("vol_ratio"), "is_anomaly")


@query(f"""{EV}, d AS (SELECT user_id, CAST(floor(t / 96) AS BIGINT) AS day, CAST(sum(value) AS DOUBLE) AS y FROM e GROUP BY 1, 2),
l AS (SELECT *, list(y) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS ref FROM d),
m AS (SELECT *, list_aggregate(ref, 'median') AS med FROM l), n AS (SELECT *, list_aggregate(list_transform(ref, lambda x: abs(x - med)), 'median') AS mad FROM m)
SELECT user_id, day, round(y, 6) AS y, round(CASE WHEN mad > 0 THEN 0.6745 * (y - med) / mad ELSE 0 END, 6) AS z FROM n""")
def robust_z_trailing(spark, sf_dir):
    """WIN-04, AGG-12: a user's day against the 60 days before it, by median and MAD."""
    d = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("t") / 96).cast("long").alias("day")).agg(F.sum("value").alias("y"))
    ref = F.collect_list("y").over(W.partitionBy("user_id").orderBy("day").rowsBetween(-60, -1))
    # z in a step of its own: beside an alias y, the y in its lambdas would be the rounded one
    d = d.withColumn("ref", ref).withColumn("z", stats.robust_z(F.col("y"), F.col("ref")))
    return d.select("user_id", "day", r6(F.col("y")).alias("y"), r6(F.col("z")).alias("z"))


@query(f"""{EV}, c AS (SELECT t, count(*) AS n FROM e GROUP BY t HAVING count(*) >= 4), g AS (SELECT t, n, t - row_number() OVER (ORDER BY t) AS island FROM c)
SELECT min(t) AS first_win, max(t) AS last_win, CAST(count(*) AS BIGINT) AS wins, CAST(sum(n) AS BIGINT) AS n_rows FROM g GROUP BY island HAVING count(*) >= 3""")
def burst_streaks(spark, sf_dir):
    """WIN-10: runs of three or more windows in a row with four or more rows each."""
    c = events(spark, sf_dir).groupBy("t").agg(F.count("*").alias("n")).where("n >= 4")
    g = c.withColumn("island", F.col("t") - F.row_number().over(W.orderBy("t")))
    return g.groupBy("island").agg(F.min("t").alias("first_win"), F.max("t").alias("last_win"), F.count("*").alias("wins"), F.sum("n").alias("n_rows")).where("wins >= 3").drop("island")


ALPHA = f"""{EV}, y AS (SELECT user_id, t, CAST(count(*) AS DOUBLE) AS y FROM e GROUP BY ALL),
p AS (SELECT user_id, event_type, CAST(floor(t / 96) AS BIGINT) AS day, count(*) AS n FROM e GROUP BY ALL),
x AS (SELECT y.user_id, y.t, y.y, p.event_type AS source, 0.01 * p.n AS part FROM y JOIN p ON p.user_id = y.user_id AND p.day = CAST(floor(y.t / 96) AS BIGINT) - 1),
u AS (SELECT user_id, t, y, 0.5 + coalesce((SELECT sum(part) FROM x WHERE x.user_id = y.user_id AND x.t = y.t), 0) AS lam FROM y),
m AS (SELECT user_id, t, 'BOT' AS source, (least(y, lam) * 0.5 / lam + greatest(y - lam, 0)) / y AS alpha FROM u
UNION ALL SELECT x.user_id, x.t, x.source, least(u.y, lam) * part / lam / u.y FROM x JOIN u ON u.user_id = x.user_id AND u.t = x.t)"""


def alpha_rows(e: DataFrame) -> DataFrame:
    """(user_id, t, source, alpha, y): shares of a window's count that its base and the day before explain."""
    from tidemark.operators.attention import attribute

    y = e.groupBy("user_id", "t").agg(F.count("*").cast("double").alias("y"))
    p = e.groupBy("user_id", "event_type", F.floor(F.col("t") / 96).cast("long").alias("day")).agg((0.01 * F.count("*")).alias("part"))
    parts = y.withColumn("day", F.floor(F.col("t") / 96).cast("long") - 1).join(p, ["user_id", "day"]).select("user_id", "t", F.col("event_type").alias("source"), "part")
    return attribute(y.withColumn("base", F.lit(0.5)), parts, ["user_id", "t"])


@query(f"{ALPHA} SELECT user_id, t AS win, source, round(alpha, 6) AS alpha FROM m WHERE alpha >= 0.01")
def alpha_shares(spark, sf_dir):
    """E2B-05, PF-06: each source's share of the count, at or above one hundredth."""
    return alpha_rows(events(spark, sf_dir)).where("alpha >= 0.01").select("user_id", F.col("t").alias("win"), "source", r6(F.col("alpha")).alias("alpha"))


@query(f"""{ALPHA}, k AS (SELECT max(t) AS hi FROM e), q AS (SELECT *, exp(-(SELECT hi - u.t FROM k) * 0.25 / 72.0) AS w FROM u),
d AS (SELECT user_id, sum(w * y) AS den FROM q GROUP BY 1), n AS (SELECT m.user_id, source, sum(w * y * alpha) AS num FROM m JOIN q ON q.user_id = m.user_id AND q.t = m.t WHERE alpha >= 0.01 GROUP BY ALL)
SELECT n.user_id, source, round(num / den, 6) AS p FROM n JOIN d ON d.user_id = n.user_id""")
def weighted_edge_prob(spark, sf_dir):
    """AGG-10, MTH-10, JOIN-15: decayed share of a target's attention that each source explains."""
    return edge_probabilities(events(spark, sf_dir)).select("user_id", "source", r6(F.col("p")).alias("p"))


def edge_probabilities(e: DataFrame) -> DataFrame:
    a = alpha_rows(e)
    hi = e.agg(F.max("t")).scalar()
    a = a.withColumn("w", F.exp(-(hi - F.col("t")) * 0.25 / 72.0))
    den = a.where("source = 'BOT'").groupBy("user_id").agg(F.sum(F.col("w") * F.col("y")).alias("den"))
    num = a.where("alpha >= 0.01").groupBy("user_id", "source").agg(F.sum(F.col("w") * F.col("y") * F.col("alpha")).alias("num"))
    return num.join(den, "user_id").select("user_id", "source", F.try_divide(F.col("num"), F.col("den")).alias("p"))


@query(f"""{ALPHA}, k AS (SELECT max(t) AS hi FROM e), q AS (SELECT *, exp(-(SELECT hi - u.t FROM k) * 0.25 / 72.0) AS w FROM u),
n AS (SELECT m.user_id, source, sum(w * y * alpha) AS num FROM m JOIN q ON q.user_id = m.user_id AND q.t = m.t WHERE alpha >= 0.01 GROUP BY ALL),
s AS (SELECT *, num / sum(num) OVER (PARTITION BY user_id) AS p FROM n)
SELECT user_id, source, CAST(round_even(round(1000 * (-ln(p) + 0.3), 4), 0) AS BIGINT) AS cost_mnat FROM s WHERE p >= 0.01""")
def edge_costs(spark, sf_dir):
    """MTH-11, MTH-08: renormalised parents' probabilities as integer costs, those under one hundredth left out."""
    n = edge_probabilities(events(spark, sf_dir))
    p = n.withColumn("p", F.col("p") / F.sum("p").over(W.partitionBy("user_id"))).where("p >= 0.01")
    return p.select("user_id", "source", F.rint(F.round(1000 * (-F.log("p") + 0.3), 4)).cast("long").alias("cost_mnat"))


@query("""WITH d AS (SELECT doc_id % (SELECT count(*) FROM embeddings) AS v, CASE WHEN regexp_matches(lower(text), '(license|licensed|http|@)') THEN 1.0 ELSE 0.0 END AS hit, exp(-CAST(n_chars AS DOUBLE) / 10000) AS w FROM documents),
j AS (SELECT label, hit, w FROM d JOIN embeddings e ON e.vec_id = d.v), a AS (SELECT sum(w) AS a, sum(w * hit) AS ax FROM j),
l AS (SELECT label, sum(w) AS u, sum(w * hit) AS ux FROM j GROUP BY label HAVING sum(w * hit) > 0),
s AS (SELECT label, ln((ux / u) / (ax / a) + 0.001) AS score FROM l, a)
SELECT label, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, label) AS INTEGER) AS place FROM s QUALIFY place <= 25""")
def lift_links(spark, sf_dir):
    """AGG-11, WIN-09, PF-05: how much more of a group's decayed weight hits a terminal's pattern; the top 25 links."""
    from tidemark.operators.search import link_scores

    e = table(spark, sf_dir, "embeddings", "vec_id", "label")
    n = e.agg(F.count("*")).scalar()
    d = table(spark, sf_dir, "documents", "doc_id", "text", "n_chars")
    d = d.select((F.col("doc_id") % n).alias("vec_id"), F.lower("text").rlike("(license|licensed|http|@)").alias("hit"), F.exp(-F.col("n_chars").cast("double") / 10000).alias("w"))
    s = link_scores(d.join(e, "vec_id"), "label", "hit", "w")
    place = F.row_number().over(W.orderBy(F.desc("score"), "label"))  # one row per group
    return s.withColumn("place", place).where("place <= 25").select("label", r6(F.col("score")).alias("score"), "place")


OLS = """WITH d AS (SELECT o_orderpriority AS s, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS c FROM orders GROUP BY 1, 2),
k AS (SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS c FROM orders GROUP BY 1),
rs AS (SELECT s, day, c / lag(c) OVER (PARTITION BY s ORDER BY day) - 1 AS r FROM d), rm AS (SELECT day, c / lag(c) OVER (ORDER BY day) - 1 AS m FROM k),
j AS (SELECT s, rs.day, r, m FROM rs JOIN rm ON rm.day = rs.day),
f AS (SELECT *, regr_slope(r, m) OVER w AS b, regr_intercept(r, m) OVER w AS a, regr_count(r, m) OVER w AS n, regr_sxx(r, m) OVER w AS sxx, regr_syy(r, m) OVER w AS syy, regr_sxy(r, m) OVER w AS sxy, regr_avgx(r, m) OVER w AS mx
FROM j WINDOW w AS (PARTITION BY s ORDER BY day ROWS BETWEEN 260 PRECEDING AND 11 PRECEDING)),
g AS (SELECT s, day, n, a, b, r - a - b * m AS ar, (syy - sxy * sxy / sxx) / (n - 2) * (1 + 1.0 / n + (m - mx) * (m - mx) / sxx) AS v FROM f WHERE n >= 200)"""


@query(f"{OLS} SELECT s AS symbol, day, CAST(n AS BIGINT) AS n, round(a, 6) AS alpha, round(b, 6) AS beta, round(ar, 6) AS ar, round(ar / sqrt(v), 6) AS sar FROM g")
def market_model_ols(spark, sf_dir):
    """AGG-13, WIN-02, WIN-03, JOIN-07: abnormal return of a series against the market, fitted on 250 earlier days."""
    return daily_model(spark, sf_dir).select("symbol", "day", "n", r6(F.col("alpha")).alias("alpha"), r6(F.col("beta")).alias("beta"), r6(F.col("ar")).alias("ar"), r6(F.col("sar")).alias("sar"))


def daily_model(spark, sf_dir) -> DataFrame:
    from tidemark.operators.observer import market_model, returns

    o = table(spark, sf_dir, "orders", "o_orderpriority", F.to_date("o_orderdate").alias("day"), "o_totalprice")
    sums = o.groupBy("o_orderpriority", "day").agg(F.sum("o_totalprice").alias("v"), F.count("*").alias("n"))
    own = returns(sums.select(F.col("o_orderpriority").alias("symbol"), "day", (F.col("v") / F.col("n")).alias("close")))
    market = sums.groupBy("day").agg((F.sum("v") / F.sum("n")).alias("close")).withColumn("symbol", F.lit("market"))
    return market_model(own, returns(market))


@query(f"""{OLS}, e AS (SELECT s, day, ar FROM g), p AS (SELECT x.s AS a, y.s AS b, corr(x.ar, y.ar) AS c, count(*) AS n FROM e x JOIN e y ON x.day = y.day AND x.s < y.s GROUP BY 1, 2)
SELECT a, b, CAST(n AS BIGINT) AS n, round(CASE WHEN n < 60 THEN 0 ELSE c END, 6) AS corr FROM p""")
def residual_corr_pairs(spark, sf_dir):
    """AGG-14, JOIN-10: correlation of abnormal returns over shared days, zero under 60 of them."""
    from tidemark.operators.observer import residual_correlations

    return residual_correlations(daily_model(spark, sf_dir).select("symbol", "day", "ar")).select("a", "b", "n", r6(F.col("corr")).alias("corr"))


@query()
def connected_components_of_pairs(spark, sf_dir):
    """AGG-15: the least node reachable, over the links of all orders between customer ids. Union-find on a small table is its test: recursive SQL takes too long over all links."""
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey")
    return connected_components(o.select(F.col("o_custkey").alias("a"), (F.col("o_custkey") * 7 + F.col("o_orderkey")).alias("b")))


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT day, timezone('America/New_York', CAST(day AS TIMESTAMP) + INTERVAL 4 HOUR) AT TIME ZONE 'UTC' AS early_utc, timezone('America/New_York', CAST(day AS TIMESTAMP) + INTERVAL 570 MINUTE) AT TIME ZONE 'UTC' AS regular_utc, timezone('Europe/Amsterdam', CAST(day AS TIMESTAMP) + INTERVAL 9 HOUR) AT TIME ZONE 'UTC' AS amsterdam_utc FROM d""")
def session_cutoffs_utc(spark, sf_dir):
    """SCA-12, OBS-03: session starts in UTC with daylight saving, per day of the table."""
    d = table(spark, sf_dir, "orders", F.to_date("o_orderdate").alias("day")).distinct()
    at = lambda venue, early: clock.session_open_utc(F.col("day"), F.lit(venue), F.lit(early)).cast("timestamp_ntz")
    return d.select("day", at("US", True).alias("early_utc"), at("US", False).alias("regular_utc"), at("AS", False).alias("amsterdam_utc"))


_TRACK = "|".join(text.TRACKERS)
URLS = f"""WITH p AS (SELECT page_id, html, regexp_replace(regexp_replace(url, '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS u FROM pages),
h AS (SELECT *, lower(regexp_extract(u, '^([^/?]*)', 1)) AS h0, regexp_replace('/' || regexp_extract(u, '^[^/?]*/?([^?]*)', 1), '/{{2,}}', '/', 'g') AS p0,
list_sort(list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(split_part(x, '=', 1)), '^({_TRACK}|utm_.*)$'))) AS q FROM p),
c AS (SELECT page_id, html, CASE WHEN len(string_split(h0, '.')) >= 3 THEN regexp_replace(h0, '^(www|m|amp|mobile)\\.', '') ELSE h0 END AS host,
regexp_replace(regexp_replace(p0, '/amp/?$', '/'), '(.)/$', '\\1') AS path, array_to_string(q, '&') AS q FROM h),
k AS (SELECT *, 'https://' || host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canon FROM c)"""


@query(f"""{URLS}, l AS (SELECT *, string_split(host, '.') AS x FROM k)
SELECT page_id, sha256(canon) AS url_key, CASE WHEN len(x) >= 3 AND x[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') AND length(x[-1]) = 2 THEN x[-3] || '.' || x[-2] || '.' || x[-1] ELSE x[-2] || '.' || x[-1] END AS domain FROM l""")
def url_key_and_domain(spark, sf_dir):
    """SCA-01..03: key of the canonical address, and the registrable domain."""
    p = table(spark, sf_dir, "pages", "page_id", "url").withColumn("canon", text.canonical_url_udf("url"))
    host = F.regexp_extract("canon", "^https://([^/]*)", 1)
    return p.select("page_id", F.sha2("canon", 256).alias("url_key"), text.registrable_domain(host).alias("domain"))


@query(f"""{URLS} SELECT sha256(canon) AS url_key, min(page_id) AS first_page, CAST(count(*) AS BIGINT) AS copies FROM k GROUP BY canon""")
def l1_dedup_first_seen(spark, sf_dir):
    """JOIN-03, WIN-01, AGG-21: the first page of each canonical address, by expressions alone."""
    p = table(spark, sf_dir, "pages", "page_id", text.plain_canonical(F.col("url")).alias("canon"))
    return p.groupBy("canon").agg(F.min("page_id").alias("first_page"), F.count("*").alias("copies")).select(F.sha2("canon", 256).alias("url_key"), "first_page", "copies")


@query("""WITH d AS (SELECT doc_id, source, trim(regexp_replace(regexp_replace(lower(split_part(text, chr(10), 1)), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS title FROM documents)
SELECT title, min(doc_id) AS root, CAST(count(*) AS BIGINT) AS members, CAST(count(DISTINCT source) AS BIGINT) AS outlets FROM d GROUP BY title""")
def title_groups(spark, sf_dir):
    """SCA-15, AGG-21, SET-02: documents under one normalised first line."""
    d = table(spark, sf_dir, "documents", "doc_id", "source", text.plain_title(F.substring_index("text", "\n", 1)).alias("title"))
    return d.groupBy("title").agg(F.min("doc_id").alias("root"), F.count("*").alias("members"), F.count_distinct("source").alias("outlets"))


@query("""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '(?is)<noscript\\b.*?</noscript>', ' ', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?i)</(p|div|h[1-6]|li|tr)>|<br\\s*/?>', chr(10), 'g'), '(?s)<[^>]+>', ' ', 'g') AS h FROM a)
SELECT page_id, CAST(length(trim(regexp_replace(regexp_replace(h, '[ \\t\\r\\f]+', ' ', 'g'), '\\s*\\n\\s*', chr(10), 'g'))) AS INTEGER) AS n FROM b""")
def html_to_text_len(spark, sf_dir):
    """SCA-21: code points of a page's visible text, entities left as they are."""
    return table(spark, sf_dir, "pages", "page_id", F.char_length(text.html_to_text(F.col("html"), unescape=False)).alias("n"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e),
p AS (SELECT i AS tb, j AS bit, list_transform(range(1, 65), lambda d: sin(12.9898 * d + 78.233 * (j + 1) + 37.719 * (i + 1))) AS w FROM range(6) a(i), range(12) b(j))
SELECT vec_id, CAST(tb AS INTEGER) AS tb, CAST(sum(CASE WHEN list_dot_product(v, w) >= 0 THEN 1 << bit ELSE 0 END) AS INTEGER) AS k FROM u, p GROUP BY 1, 2""")
def hyperplane_keys(spark, sf_dir):
    """E2A-02, JOIN-14: the six buckets of every vector, by the signs of twelve products each."""
    from tidemark.operators import narratives

    return narratives.hyperplane_keys(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id", "embedding")


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e)
SELECT x.vec_id AS a, y.vec_id AS b, round(list_dot_product(x.v, y.v), 6) AS cosine FROM u x JOIN u y ON x.vec_id < y.vec_id WHERE list_dot_product(x.v, y.v) >= 0.3""")
def near_dup_pairs(spark, sf_dir):
    """SCA-31, JOIN-14: all pairs that have a cosine of 0.3 or more, in whatever buckets they lie, by products of blocks."""
    from tidemark.operators.narratives import all_pairs

    return all_pairs(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", 0.3).select("a", "b", r6(F.col("cosine")).alias("cosine"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT q.vec_id AS query, e.vec_id AS neighbour, list_dot_product(q.v, e.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(e.v, e.v)) AS c FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0)
SELECT query, neighbour, round(c, 6) AS cosine, CAST(row_number() OVER (PARTITION BY query ORDER BY round(c, 9) DESC, neighbour) AS INTEGER) AS place FROM p QUALIFY place <= 20""")
def top_k_neighbours(spark, sf_dir):
    """JOIN-13, WIN-09, E2B-10: the 20 nearest of every row for each query, a query being a row whose id 50 divides."""
    from tidemark.operators.narratives import nearest

    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return nearest(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 20).select("query", "neighbour", r6(F.col("cosine")).alias("cosine"), "place")


@query("""WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(least(greatest(round_even(CAST(x AS DOUBLE) * 127, 0), -127), 127) AS INTEGER)) AS q FROM embeddings)
SELECT vec_id, CAST(list_sum(q) AS BIGINT) AS total, CAST(list_dot_product(CAST(q AS DOUBLE[]), CAST(q AS DOUBLE[])) AS BIGINT) AS squares, CAST(list_max(q) AS INTEGER) AS most FROM q""")
def int8_quantize(spark, sf_dir):
    """SCA-30: vectors as int8, with sums that show each component's rounding."""
    q = table(spark, sf_dir, "embeddings", "vec_id", vectors.to_int8(F.col("embedding")).alias("q"))
    return q.select("vec_id", F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x).alias("squares"), F.array_max("q").cast("int").alias("most"))


@query("""WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w, source, lang FROM documents),
p AS (SELECT doc_id, w, lag(w) OVER o AS v, lag(doc_id) OVER o AS prior FROM w WINDOW o AS (PARTITION BY source, lang ORDER BY doc_id))
SELECT prior AS a, doc_id AS b, round(CASE WHEN len(list_distinct(list_concat(v, w))) = 0 THEN 0 ELSE len(list_intersect(v, w)) / len(list_distinct(list_concat(v, w))) END, 6) AS jaccard FROM p WHERE prior IS NOT NULL""")
def entity_jaccard(spark, sf_dir):
    """SCA-29, SCA-32, SET-02: names of a whole document against those of its outlet's document before."""
    w = table(spark, sf_dir, "documents", "doc_id", "source", "lang", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    o = W.partitionBy("source", "lang").orderBy("doc_id")
    p = w.select("doc_id", "w", F.lag("w").over(o).alias("v"), F.lag("doc_id").over(o).alias("prior")).where("prior IS NOT NULL")
    return p.select(F.col("prior").alias("a"), F.col("doc_id").alias("b"), r6(vectors.jaccard(F.col("v"), F.col("w"))).alias("jaccard"))


@query("""WITH t AS (SELECT 2 * doc_id AS id, source AS subject, split_part(text, chr(10), 1) AS x FROM documents UNION ALL SELECT 2 * conv_id + 1, role, text FROM conversations),
c AS (SELECT subject, 'alleges' AS predicate, count(*) FILTER (WHERE regexp_matches(x, '(?i)\\b(alleg\\w*|accus\\w*|claims?|suspect\\w*|reportedly)\\b') AND NOT regexp_matches(x, '(?i)\\b(denied|denies|deny|refuted|rejects?|dismiss\\w*|disput\\w*)\\b')) AS n, count(*) AS total FROM t GROUP BY 1
UNION ALL SELECT subject, 'denies', count(*) FILTER (WHERE regexp_matches(x, '(?i)\\b(denied|denies|deny|refuted|rejects?|dismiss\\w*|disput\\w*)\\b')), count(*) FROM t GROUP BY 1
UNION ALL SELECT subject, 'released', count(*) FILTER (WHERE regexp_matches(x, '(?i)\\b(releases?|released|launch(es|ed)?|unveil(s|ed)?|rolls? out|debuts?|introduc(es|ed))\\b')), count(*) FROM t GROUP BY 1)
SELECT subject, predicate, CAST(n AS BIGINT) AS n, CAST(total AS BIGINT) AS total FROM c""")
def claim_rules(spark, sf_dir):
    """E3B-03, E3B-05: claims that wording in titles and quotes makes, counted per subject."""
    from tidemark.operators.verdicts import title_claims

    d = table(spark, sf_dir, "documents", F.col("source").alias("subject"), F.substring_index("text", "\n", 1).alias("x"))
    t = d.unionByName(table(spark, sf_dir, "conversations", F.col("role").alias("subject"), F.col("text").alias("x")))
    made = t.select("subject", title_claims(F.col("x")).alias("c"))
    counts = made.groupBy("subject").agg(F.count("*").alias("total"), *[F.count_if(F.array_contains(F.transform("c", lambda c: c["predicate"]), p)).alias(p) for p in ("alleges", "denies", "released")])
    return counts.select("subject", "total", F.explode(F.create_map(*[x for p in ("alleges", "denies", "released") for x in (F.lit(p), F.col(p))])).alias("predicate", "n"))


@query(f"""{URLS}, s AS (SELECT canon, min(page_id) AS first_page FROM k GROUP BY canon), x AS (SELECT page_id, first_page FROM k JOIN s USING (canon)),
t AS (SELECT x.page_id, e.ts AS seen, f.ts AS first_seen FROM x JOIN events e ON e.event_id = x.page_id JOIN events f ON f.event_id = x.first_page)
SELECT page_id, CASE WHEN first_seen < TIMESTAMP '2024-01-01 06:00:00' THEN 'PRE' WHEN seen < TIMESTAMP '2024-01-01 12:00:00' THEN 'LATE' ELSE 'POST' END AS status FROM t""")
def evidence_admissibility(spark, sf_dir):
    """PF-09, JOIN-04: whether a page, or the first of its address, was seen before the cutoff."""
    k = table(spark, sf_dir, "pages", "page_id", text.plain_canonical(F.col("url")).alias("canon"))
    first = k.groupBy("canon").agg(F.min("page_id").alias("first_page"))
    e = table(spark, sf_dir, "events", "event_id", "ts")
    t = k.join(first, "canon").join(e.select(F.col("event_id").alias("page_id"), F.col("ts").alias("seen")), "page_id").join(e.select(F.col("event_id").alias("first_page"), F.col("ts").alias("first_seen")), "first_page")
    at = lambda s: F.to_timestamp_ntz(F.lit(s))
    return t.select("page_id", F.when(F.col("first_seen") < at("2024-01-01 06:00:00"), "PRE").when(F.col("seen") < at("2024-01-01 12:00:00"), "LATE").otherwise("POST").alias("status"))


@query("""WITH u AS (SELECT user_id, min(ts) + INTERVAL 10 DAY AS tau FROM events GROUP BY 1),
b AS (SELECT u.user_id, arg_max(event_id, (ts, event_id)) AS snap FROM u JOIN events e ON e.user_id = u.user_id AND e.event_type = 'purchase' AND e.ts <= u.tau GROUP BY 1),
a AS (SELECT user_id, arg_min(event_id, (ts, event_id)) AS snap FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT u.user_id, coalesce(b.snap, a.snap) AS snapshot, b.snap IS NOT NULL AS before FROM u LEFT JOIN b USING (user_id) LEFT JOIN a USING (user_id)""")
def as_of_snapshot(spark, sf_dir):
    """JOIN-09: the latest snapshot at or before a cutoff, else the earliest one after."""
    from tidemark.operators.dedup import as_of

    e = table(spark, sf_dir, "events", "user_id", "event_id", "event_type", "ts")
    u = e.groupBy("user_id").agg((F.min("ts") + F.expr("INTERVAL 10 DAYS")).alias("tau"))
    return as_of(u, e.where("event_type = 'purchase'"), "user_id", "tau", "ts", "event_id").select("user_id", F.col("event_id").alias("snapshot"), "before")


@query(f"""{EV}, c AS (SELECT user_id, CAST(floor(t / 96) AS BIGINT) AS day, count(*) AS c FROM e GROUP BY 1, 2), r AS (SELECT user_id, arg_max(c, day) AS real, max(day) AS day FROM c GROUP BY 1)
SELECT r.user_id, CAST(count(c.c) AS BIGINT) AS k, round((1.0 + count(*) FILTER (WHERE c.c <= real)) / (1 + count(c.c)), 6) AS p, round(coalesce(avg(CASE WHEN c.c >= 3 THEN 1.0 ELSE 0.0 END) FILTER (WHERE c.c IS NOT NULL), 0), 6) AS fer
FROM r LEFT JOIN c ON c.user_id = r.user_id AND c.day < r.day GROUP BY r.user_id, real""")
def empirical_p_and_fer(spark, sf_dir):
    """AGG-16: a user's last day against its placebo days: p = (1 + those at or below) / (1 + K), and the share explained."""
    c = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("t") / 96).cast("long").alias("day")).agg(F.count("*").alias("c"))
    r = c.groupBy("user_id").agg(F.max_by("c", "day").alias("real"), F.max("day").alias("last"))
    j = c.join(r, "user_id")
    early = F.col("day") < F.col("last")
    g = j.groupBy("user_id").agg(F.count_if(early).alias("k"), F.count_if(early & (F.col("c") <= F.col("real"))).alias("low"), F.count_if(early & (F.col("c") >= 3)).alias("hits"))
    return g.select("user_id", "k", r6((1 + F.col("low")) / (1 + F.col("k"))).alias("p"), r6(F.when(F.col("k") > 0, F.col("hits") / F.col("k")).otherwise(0.0)).alias("fer"))


@query("""WITH l AS (SELECT CAST(l_shipdate AS DATE) AS day, l_orderkey AS k, l_linenumber AS n, l_extendedprice / l_quantity AS p, l_quantity AS v FROM lineitem)
SELECT day, round(arg_min(p, (k, n, p)), 6) AS open, round(max(p), 6) AS high, round(min(p), 6) AS low, round(arg_max(p, (k, n, p)), 6) AS close, round(sum(p * v) / sum(v), 6) AS vwap, round(stddev_pop(p), 6) AS sd FROM l GROUP BY day""")
def vwap_ohlc(spark, sf_dir):
    """AGG-20: a day's first, highest, lowest, last and volume-weighted price, and its spread."""
    from tidemark.operators.observer import session_bars

    t = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("day"), F.struct("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.col("l_quantity")).alias("p")).alias("at"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"))
    return session_bars(t, "day").select("day", *[r6(F.col(c)).alias(c) for c in ("open", "high", "low", "close", "vwap", "sd")])


@query(f"""{EV}, y AS (SELECT user_id, t, CAST(count(*) AS DOUBLE) AS y FROM e GROUP BY 1, 2), b AS (SELECT user_id, min(t) AS lo, max(t) AS hi FROM e GROUP BY 1), d AS (SELECT user_id, unnest(range(lo, hi + 1)) AS t FROM b)
SELECT a.user_id, a.t AS win, {", ".join(f"round(coalesce(sum((1 - exp(-0.25 / {tau})) * exp(-0.25 / {tau} * (a.t - 1 - b.t)) * b.y), 0), 6) AS z{n}" for n, tau in (("1h", "1.0"), ("6h", "6.0"), ("1d", "24.0"), ("1w", "168.0")))}
FROM d a LEFT JOIN y b ON b.user_id = a.user_id AND b.t < a.t GROUP BY 1, 2""")
def ewma_traces_1h_6h_1d_1w(spark, sf_dir):
    """WIN-07: decayed sums of the counts before each window, four time constants, from each user's first window to its last."""
    from tidemark.operators.attention import traces_of

    z = traces_of(events(spark, sf_dir).groupBy("user_id", "t").agg(F.count("*").cast("double").alias("y")), "user_id", "t", "y")
    return z.select("user_id", F.col("t").alias("win"), *[r6(F.col(c)).alias(c) for c in ("z1h", "z6h", "z1d", "z1w")])


@query(f"""{ALPHA}, k AS (SELECT max(t) AS hi FROM e), q AS (SELECT *, exp(-(SELECT hi - u.t FROM k) * 0.25 / 72.0) AS w FROM u),
n AS (SELECT m.user_id, source, sum(w * y * alpha) AS num FROM m JOIN q ON q.user_id = m.user_id AND q.t = m.t WHERE alpha >= 0.01 GROUP BY ALL),
s AS (SELECT *, num / sum(num) OVER (PARTITION BY user_id) AS p FROM n), c AS (SELECT user_id, source, CASE WHEN source = 'BOT' THEN 3300 ELSE 700 + CAST(round_even(1000 * (-ln(p) + 0.3), 0) AS BIGINT) END AS c FROM s WHERE p >= 0.01),
b AS (SELECT user_id, min(c) AS best, max(CASE WHEN source = 'BOT' THEN 3300 ELSE 0 END) AS direct, arg_min(source, (c, source <> 'BOT', source)) AS via FROM c GROUP BY 1)
SELECT user_id, 0::INTEGER AS part, CAST(best AS BIGINT) AS cost, CAST(direct AS BIGINT) AS abstain_cost, CASE WHEN via = 'BOT' THEN 'BOT>target' ELSE 'BOT>' || via || ',' || via || '>target' END AS tree,
coalesce((SELECT string_agg(source || ':' || c, ',' ORDER BY c, source) FROM c WHERE c.user_id = b.user_id AND source <> 'BOT' AND c <= best + 2996), '') AS rivals FROM b""")
def min_arborescence(spark, sf_dir):
    """E3A-04..07: the cheapest explanation of each user's terminals over its own cost graph, with rival entries."""
    from tidemark.operators.search import explain_graphs

    n = edge_probabilities(events(spark, sf_dir)).withColumn("p", F.col("p") / F.sum("p").over(W.partitionBy("user_id")))
    cost = n.where("p >= 0.01").select("user_id", "source", stats.edge_cost(F.col("p")).alias("cost"))
    roots = cost.select("user_id", F.lit("BOT").alias("u"), F.when(F.col("source") == "BOT", "target").otherwise(F.col("source")).alias("v"), F.when(F.col("source") == "BOT", F.lit(3300)).otherwise(700).cast("long").alias("cost"))
    links = cost.where("source <> 'BOT'").select("user_id", F.col("source").alias("u"), F.lit("target").alias("v"), "cost")
    return explain_graphs(roots.unionByName(links), "user_id", terminals=["target"])


@query()
def four_bit_verdicts(spark, sf_dir):
    """E3B-07..10: each user as a hypothesis, its events as reports, judged by every coherent reading of the conflicts."""
    from tidemark.operators.verdicts import decide_facts, event_facts

    return decide_facts(event_facts(table(spark, sf_dir, "events")))


@query()
def l2_copy_groups(spark, sf_dir):
    """E1-02..04: copy groups of documents by title, image and names, replayed inside components."""
    from tidemark.operators.dedup import copy_groups, documents_as_articles

    return copy_groups(documents_as_articles(table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")))


@query()
def bocpd_bursts(spark, sf_dir):
    """E2B-04, MTH-09: change points of each user's daily counts, and which of them are bursts."""
    from tidemark.operators.attention import bursts

    c = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("t") / 4).cast("long").alias("t")).agg(F.count("*").alias("y"))
    return bursts(c, "user_id", "t", "y")


@query()
def narrative_window_steps(spark, sf_dir):
    """E2A-01, E2A-04, E2A-14: vectors as they come, assigned to event clusters, with their membership shares."""
    from tidemark.operators.narratives import assign_events

    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding", F.col("label").cast("string").alias("entity"))
    return assign_events(e, "vec_id", "embedding", "entity")


@query()
def attention_fit(spark, sf_dir):
    """E2B-02, E2B-06..08: sparse excitation rows of each user, fitted on its daily counts."""
    from tidemark.operators.attention import fit_rows

    c = events(spark, sf_dir).groupBy("user_id", F.col("event_type").alias("source"), F.floor(F.col("t") / 4).cast("long").alias("t")).agg(F.count("*").cast("double").alias("y"))
    return fit_rows(c, "user_id", "source", "t", "y")


def window_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every user's window counts against the day before it, the strongest bursts first."""
    e = events(spark, sf_dir)
    y = e.groupBy("user_id", "t").agg(F.count("*").alias("y"))
    grid = e.groupBy("user_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).select("user_id", F.explode(F.sequence("lo", "hi")).alias("t"))
    d = grid.join(y, ["user_id", "t"], "left").select("user_id", "t", F.coalesce("y", F.lit(0)).cast("double").alias("y"))
    # running sums and their difference over a day: one step a row, where a sliding frame takes 96
    own = W.partitionBy("user_id").orderBy("t")
    z = d.select("user_id", "t", "y", F.row_number().over(own).alias("i"), *[F.coalesce(F.sum(x).over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias(n) for x, n in ((F.col("y"), "s1"), (F.col("y") * F.col("y"), "s2"))])
    z = z.select("user_id", "t", "y", "i", *[(F.col(n) - F.lag(n, 96).over(own)).alias(n) for n in ("s1", "s2")]).where("i > 96 AND 96 * s2 > s1 * s1")
    z = z.select("user_id", F.col("t").alias("win"), F.col("y").cast("long").alias("y"), r6(F.try_divide(96 * F.col("y") - F.col("s1"), F.sqrt(96 * F.col("s2") - F.col("s1") * F.col("s1")))).alias("z"))
    return z.where("z >= 4").orderBy(F.desc("z"), "user_id", "win")


QUERIES["window_bursts"] = window_bursts
SQL["window_bursts"] = f"""{EV}, b AS (SELECT user_id, min(t) AS lo, max(t) AS hi FROM e GROUP BY 1), g AS (SELECT user_id, unnest(range(lo, hi + 1)) AS t FROM b),
y AS (SELECT user_id, t, count(*) AS y FROM e GROUP BY 1, 2), d AS (SELECT g.user_id, g.t, CAST(coalesce(y, 0) AS DOUBLE) AS y FROM g LEFT JOIN y ON y.user_id = g.user_id AND y.t = g.t),
z AS (SELECT *, avg(y) OVER w AS m, stddev_pop(y) OVER w AS s, count(*) OVER w AS n FROM d WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN 96 PRECEDING AND 1 PRECEDING))
SELECT user_id, t AS win, CAST(y AS BIGINT) AS y, round((y - m) / s, 6) AS z FROM z WHERE n = 96 AND s > 0 AND round((y - m) / s, 6) >= 4"""
