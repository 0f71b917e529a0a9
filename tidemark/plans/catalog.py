"""More registered queries: the relational operators one by one, over the shared tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import clock, stats, text
from tidemark.operators import observer
from tidemark.plans.queries import ALPHA, EV, alpha_rows, daily_model, events, query, r6, table


@query(f"""{EV}, g AS (SELECT user_id, event_type, min(event_id) AS root FROM e GROUP BY 1, 2)
SELECT event_id, t AS win FROM e JOIN g USING (user_id, event_type) WHERE event_id = root""")
def root_rows(spark, sf_dir):
    """PF-01: rows that are the root of their copy group."""
    e = events(spark, sf_dir)
    g = e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("root"))
    return e.join(g, ["user_id", "event_type"]).where("event_id = root").select("event_id", F.col("t").alias("win"))


@query("SELECT event_id, user_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-07 00:00:00' AND event_type IN ('click', 'purchase')")
def pruned_range_scan(spark, sf_dir):
    """PF-02..04, SRC-13, SRC-15: a half-open time range and a list of values, both pushed to the scan."""
    at = lambda d: F.to_timestamp_ntz(F.lit(d))
    e = table(spark, sf_dir, "events", "event_id", "user_id", "value", "ts", "event_type")
    return e.where((F.col("ts") >= at("2024-01-05 00:00:00")) & (F.col("ts") < at("2024-01-07 00:00:00")) & F.col("event_type").isin("click", "purchase")).select("event_id", "user_id", "value")


@query(f"""{ALPHA} SELECT CAST(count(DISTINCT (user_id, source)) AS BIGINT) AS edges, round(sum(CASE WHEN source = 'BOT' THEN alpha ELSE 0 END) / sum(alpha), 6) AS bot_share FROM m WHERE alpha >= 0.01""")
def bot_share(spark, sf_dir):
    """AGG-08, REP-01: distinct edges, and how much of all attribution lies outside."""
    a = alpha_rows(events(spark, sf_dir)).where("alpha >= 0.01")
    return a.agg(F.count_distinct("user_id", "source").alias("edges"), r6(F.sum(F.when(F.col("source") == "BOT", F.col("alpha")).otherwise(0.0)) / F.sum("alpha")).alias("bot_share"))


@query(f"""{EV}, k AS (SELECT max(t) AS hi FROM e), m AS (SELECT user_id, count(*) AS mass FROM e, k WHERE t > hi - 96 GROUP BY 1)
SELECT user_id, CAST(mass AS BIGINT) AS mass FROM m ORDER BY mass DESC, user_id LIMIT 20""")
def top_mass_last_day(spark, sf_dir):
    """AGG-09: the 20 heaviest narratives of the last 96 windows."""
    e = events(spark, sf_dir)
    hi = e.agg(F.max("t")).scalar()
    return e.where(F.col("t") > hi - 96).groupBy("user_id").agg(F.count("*").alias("mass")).orderBy(F.desc("mass"), "user_id").limit(20)  # a top-k report


@query(f"{EV} SELECT user_id, CAST(floor(t / 4) AS BIGINT) AS hour_no, CAST(count(*) AS BIGINT) AS y FROM e GROUP BY 1, 2")
def hourly_series(spark, sf_dir):
    """REP-03: counts by hour."""
    return events(spark, sf_dir).groupBy("user_id", F.floor(F.col("t") / 4).cast("long").alias("hour_no")).agg(F.count("*").alias("y"))


@query("""WITH w AS (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS x FROM documents), c AS (SELECT source, x, count(*) AS n FROM w GROUP BY 1, 2)
SELECT source, x AS subject, CAST(n AS BIGINT) AS n FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, x) = 1""")
def subject_by_outlet(spark, sf_dir):
    """AGG-05, AGG-07: the most frequent name in whole documents, the smallest in a tie."""
    w = table(spark, sf_dir, "documents", "source", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("x"))
    c = w.groupBy("source", "x").agg(F.count("*").alias("n"))
    return c.groupBy("source").agg(F.min(F.struct((-F.col("n")).alias("m"), "x")).alias("b")).select("source", F.col("b.x").alias("subject"), (-F.col("b.m")).alias("n"))


@query("""WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS x FROM documents), c AS (SELECT lang, x, count(*) AS n FROM w GROUP BY 1, 2)
SELECT lang, x AS entity, CAST(n AS BIGINT) AS n, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, x) AS INTEGER) AS place FROM c QUALIFY place <= 8""")
def entity_profiles(spark, sf_dir):
    """AGG-22, WIN-09: the eight heaviest entities of each group, in whole documents."""
    w = table(spark, sf_dir, "documents", "lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("entity"))
    c = w.groupBy("lang", "entity").agg(F.count("*").alias("n"))
    return c.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "entity"))).where("place <= 8")


@query(f"{EV} SELECT user_id, bool_or(value >= 45) AS any_burst, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS errors, CAST(sum(CAST(value AS DECIMAL(18, 9))) AS DOUBLE) AS exact_total FROM e GROUP BY 1")
def burst_flags(spark, sf_dir):
    """AGG-06, AGG-19, AGG-24: any burst, counts by kind, and a sum that no order of rows changes."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_or(F.col("value") >= 45).alias("any_burst"), F.count_if(F.col("event_type") == "error").alias("errors"), stats.exact_sum(F.col("value")).alias("exact_total"))


@query("""WITH o AS (SELECT o_orderpriority AS s, o_orderkey AS k, o_orderdate AS d FROM orders)
SELECT s, k, CAST(row_number() OVER (PARTITION BY s ORDER BY d, k) AS INTEGER) AS place FROM o QUALIFY place <= 60""")
def first_reports(spark, sf_dir):
    """SRT-02, SRT-04: the first 60 of each group in the order seen, ties by id."""
    o = table(spark, sf_dir, "orders", F.col("o_orderpriority").alias("s"), F.col("o_orderkey").alias("k"), "o_orderdate")
    return o.withColumn("place", F.row_number().over(W.partitionBy("s").orderBy("o_orderdate", "k"))).where("place <= 60").select("s", "k", "place")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def newest_feed(spark, sf_dir):
    """SRT-03: the newest 50, ties by id."""
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


@query("""WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT day, 'both' AS kind FROM (SELECT day FROM d INTERSECT SELECT day FROM o) UNION ALL SELECT day, 'todo' FROM (SELECT day FROM d EXCEPT SELECT day FROM o) UNION ALL SELECT day, 'any' FROM (SELECT day FROM d UNION SELECT day FROM o)""")
def day_sets(spark, sf_dir):
    """SET-01..06: union, intersection and difference of days."""
    d = table(spark, sf_dir, "events", F.to_date("ts").alias("day")).distinct()
    o = table(spark, sf_dir, "orders", F.to_date("o_orderdate").alias("day")).distinct()
    kind = lambda df, k: df.select("day", F.lit(k).alias("kind"))
    return kind(d.join(o, "day", "left_semi"), "both").unionByName(kind(d.join(o, "day", "left_anti"), "todo")).unionByName(kind(d.unionByName(o).distinct(), "any"))


@query("""WITH r AS (SELECT event_id, user_id, event_type, ts, min(event_id) OVER (PARTITION BY user_id, event_type) AS root FROM events), f AS (SELECT event_id AS root, ts AS root_ts FROM events)
SELECT event_id, root FROM r JOIN f USING (root) WHERE event_id <> root AND ts <= root_ts + INTERVAL 72 HOUR""")
def copies_within_72h(spark, sf_dir):
    """JOIN-05, STR-05: copies whose root is at most 72 hours old."""
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts")
    g = e.groupBy("user_id", "event_type").agg(F.min_by(F.struct(F.col("event_id").alias("root"), F.col("ts").alias("root_ts")), "event_id").alias("r")).select("user_id", "event_type", "r.*")
    return e.join(g, ["user_id", "event_type"]).where((F.col("event_id") != F.col("root")) & (F.col("ts") <= F.col("root_ts") + F.expr("INTERVAL 72 HOURS"))).select("event_id", "root")


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT day, n >= 2 AS complete FROM d)
SELECT day, complete, bool_and(complete) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS in_prefix FROM s""")
def complete_day_prefix(spark, sf_dir):
    """PF-10, JOIN-16: complete days, and those before the first gap."""
    s = table(spark, sf_dir, "orders", F.to_date("o_orderdate").alias("day")).groupBy("day").agg((F.count("*") >= 2).alias("complete"))
    return s.withColumn("in_prefix", F.bool_and("complete").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)))  # one row per day


@query("""WITH d AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS c FROM orders GROUP BY 1, 2),
p AS (SELECT *, lag(c) OVER (PARTITION BY symbol ORDER BY day) AS b FROM d), f AS (SELECT *, CASE WHEN day(day) = 15 AND b > 100 THEN ln(1 - 100 / b) ELSE 0 END AS f FROM p)
SELECT symbol, day, round(c * exp(coalesce(sum(f) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)), 4) AS adj FROM f""")
def adjusted_closes(spark, sf_dir):
    """WIN-08, JOIN-18, OBS-05: closes less the dividends to come; one of 100 on each 15th."""
    p = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("close"))
    a = p.where(F.day("date") == 15).select("symbol", "date", F.lit("dividend").alias("kind"), F.lit(100.0).alias("value"))
    return observer.adjusted(p, a).select("symbol", F.col("date").alias("day"), F.round("adj", 4).alias("adj"))


@query("""WITH d AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS c FROM orders GROUP BY 1, 2)
SELECT symbol, round(arg_max(c, day) / arg_max(c, day) FILTER (WHERE day < DATE '1998-01-01') - 1, 6) AS change FROM d GROUP BY 1""")
def change_since_reference(spark, sf_dir):
    """WIN-11: change from the last close before a day."""
    p = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("close"))
    return observer.change_since(p, F.to_date(F.lit("1998-01-01"))).select("symbol", r6(F.col("change")).alias("change"))


@query(f"{EV}, c AS (SELECT t, count(*) AS n FROM e GROUP BY 1) SELECT CAST(floor(t / 8) AS BIGINT) AS bucket, CAST(max(n) AS BIGINT) AS most, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY 1")
def bucket_peaks(spark, sf_dir):
    """WIN-12: the highest window of each bucket survives downsampling."""
    c = events(spark, sf_dir).groupBy("t").agg(F.count("*").alias("n"))
    return c.groupBy(F.floor(F.col("t") / 8).cast("long").alias("bucket")).agg(F.max("n").alias("most"), F.sum("n").alias("total"))


@query("""WITH c AS (SELECT user_id, event_type AS predicate, event_id % 2 AS polarity, event_id % 7 AS owner, event_id % 11 AS grp, min(event_id) AS id FROM events WHERE event_type IN ('error', 'login') GROUP BY ALL)
SELECT a.user_id, CAST(count(*) AS BIGINT) AS contrary, CAST(count(*) FILTER (WHERE a.owner <> b.owner AND a.grp <> b.grp) AS BIGINT) AS independent FROM c a JOIN c b ON a.user_id = b.user_id AND a.predicate = b.predicate AND a.id < b.id WHERE a.polarity <> b.polarity GROUP BY 1""")
def contrary_claims(spark, sf_dir):
    """JOIN-11, JOIN-12, E3B-07: contrary claims of one subject, and those of independent sources; claims alike are one."""
    c = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "login")).groupBy("user_id", F.col("event_type").alias("predicate"), (F.col("event_id") % 2).alias("polarity"), (F.col("event_id") % 7).alias("owner"), (F.col("event_id") % 11).alias("grp")).agg(F.min("event_id").alias("id"))
    a, b = c.alias("a"), c.alias("b")
    j = a.join(b, (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.predicate") == F.col("b.predicate")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.polarity") != F.col("b.polarity")))
    return j.groupBy(F.col("a.user_id").alias("user_id")).agg(F.count("*").alias("contrary"), F.count_if((F.col("a.owner") != F.col("b.owner")) & (F.col("a.grp") != F.col("b.grp"))).alias("independent"))


@query(r"""SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9 ]+', ' ', 'g')) || ' ' AS norm, len(list_distinct(list_filter(list_transform(string_split(text, '.'), lambda x: trim(x)), lambda x: x <> ''))) AS parts,
CASE WHEN trim(regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g'), '_') = '' THEN 'x' ELSE trim(regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g'), '_') END AS atom, TRY_CAST(split_part(text, ' ', 1) AS DOUBLE) AS number FROM documents""")
def text_scalars(spark, sf_dir):
    """SCA-16, SCA-17, SCA-22, SCA-26: whole texts normalised, split lists, identifiers, safe casts."""
    return table(spark, sf_dir, "documents", "doc_id", text.norm_text(F.col("text")).alias("norm"), F.size(text.split_list(F.col("text"), "\\.")).cast("long").alias("parts"), text.atom(F.col("source")).alias("atom"), F.substring_index("text", " ", 1).try_cast("double").alias("number"))


@query("""WITH d AS (SELECT event_id, value AS x, (isodow(ts) - 1) * 24 + hour(ts) AS h FROM events)
SELECT event_id, round(greatest(x, 0) + ln(1 + exp(-abs(x))), 6) AS softplus, round(1 / (1 + exp(-x)), 6) AS sigmoid, round(cos(2 * pi() * 7 * h / 168), 6) AS cos7, round(sin(2 * pi() * h / 168), 6) AS sin1, CAST(h AS INTEGER) AS hour_of_week FROM d""")
def math_scalars(spark, sf_dir):
    """MTH-02, MTH-03, SCA-11: stable softplus and sigmoid, harmonics of the week."""
    h = clock.hour_of_week(F.col("ts"))
    f = stats.fourier(h)
    return table(spark, sf_dir, "events", "event_id", r6(stats.softplus(F.col("value"))).alias("softplus"), r6(stats.sigmoid(F.col("value"))).alias("sigmoid"), r6(f[2]).alias("cos7"), r6(f[5]).alias("sin1"), h.cast("int").alias("hour_of_week"))


_OLS = """WITH d AS (SELECT o_orderpriority AS s, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS c FROM orders GROUP BY 1, 2),
k AS (SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS c FROM orders GROUP BY 1),
rs AS (SELECT s, day, c / lag(c) OVER (PARTITION BY s ORDER BY day) - 1 AS r FROM d), rm AS (SELECT day, c / lag(c) OVER (ORDER BY day) - 1 AS m FROM k),
j AS (SELECT s, rs.day, r, m FROM rs JOIN rm ON rm.day = rs.day),
f AS (SELECT *, regr_slope(r, m) OVER w AS b, regr_intercept(r, m) OVER w AS a, regr_count(r, m) OVER w AS n, regr_sxx(r, m) OVER w AS sxx, regr_syy(r, m) OVER w AS syy, regr_sxy(r, m) OVER w AS sxy, regr_avgx(r, m) OVER w AS mx
FROM j WINDOW w AS (PARTITION BY s ORDER BY day ROWS BETWEEN 260 PRECEDING AND 11 PRECEDING)),
g AS (SELECT s, day, r - a - b * m AS ar, (syy - sxy * sxy / sxx) / (n - 2) * (1 + 1.0 / n + (m - mx) * (m - mx) / sxx) AS v FROM f WHERE n >= 200)"""


@query(f"{_OLS} SELECT day, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE abs(round(ar / sqrt(v), 6)) >= 2) AS BIGINT) AS moved, max(abs(round(ar / sqrt(v), 6))) < 1 AS quiet FROM g GROUP BY day")
def trigger_days(spark, sf_dir):
    """PF-07, PF-08, OBS-06: series that moved on a day, and the quiet days."""
    m = daily_model(spark, sf_dir).select("day", F.abs(r6(F.col("sar"))).alias("z"))
    return m.groupBy("day").agg(F.count("*").alias("n"), F.count_if(F.col("z") >= 2).alias("moved"), (F.max("z") < 1).alias("quiet"))


@query("""SELECT page_id, sha256(chr(0) || chr(0) || chr(0) || chr(0) || chr(0) || chr(0) || chr(0) || chr(1) || 'p' || chr(0) || chr(0) || chr(0) || chr(0) || chr(0) || chr(0) || chr(0) || chr(CAST(length(CAST(page_id AS VARCHAR)) AS INTEGER)) || CAST(page_id AS VARCHAR)) AS hash FROM pages""")
def stable_ids(spark, sf_dir):
    """SCA-04: ids from length-prefixed parts."""
    return table(spark, sf_dir, "pages", "page_id", text.stable_hash(F.lit("p"), F.col("page_id").cast("string")).alias("hash"))


@query("""WITH p AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT *, 255.0::DOUBLE * n / sum(n) OVER (PARTITION BY user_id) AS raw FROM p),
f AS (SELECT *, floor(round(raw, 9)) AS base, row_number() OVER (PARTITION BY user_id ORDER BY round(round(raw, 9) - floor(round(raw, 9)), 9) DESC, event_type) AS place, 255 - sum(floor(round(raw, 9))) OVER (PARTITION BY user_id) AS spare FROM s)
SELECT user_id, event_type, CAST(base + CASE WHEN place <= spare THEN 1 ELSE 0 END AS BIGINT) AS share255 FROM f""")
def shares_255(spark, sf_dir):
    """MTH-07, E2A-04: shares as whole 255ths by largest remainder, ties to the smaller name."""
    p = table(spark, sf_dir, "events", "user_id", "event_type").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    by = W.partitionBy("user_id")
    s = p.withColumn("raw", F.round(255.0 * F.col("n") / F.sum("n").over(by), 9)).withColumn("base", F.floor("raw"))
    s = s.withColumn("place", F.row_number().over(by.orderBy(F.desc(F.round(F.col("raw") - F.col("base"), 9)), "event_type"))).withColumn("spare", 255 - F.sum("base").over(by))
    return s.select("user_id", "event_type", (F.col("base") + F.when(F.col("place") <= F.col("spare"), 1).otherwise(0)).cast("long").alias("share255"))
