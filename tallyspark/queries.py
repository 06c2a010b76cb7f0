"""Registered queries over the test tables, each beside equivalent DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tables
from .functions.columns import bucket_of, key_id, nearest_rank, truncated_rank
from .functions.held import held
from .operators import exact, generate, hybrid, metrics, placement, reduce, sketches, windows
from .plans import methods
from .sources import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# The same streams in SQL

EV = """ev AS (SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS "window", CAST(event_id % 4 AS INTEGER) AS part,
 event_id AS pos, CAST(user_id AS VARCHAR) AS key, CAST(1 AS BIGINT) AS weight FROM events)"""
LI = """li AS (SELECT CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS "window", CAST(l_orderkey % 8 AS INTEGER) AS part,
 CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS pos, CAST(l_suppkey AS VARCHAR) AS key, CAST(1 AS BIGINT) AS weight, CAST(trunc(l_quantity) AS BIGINT) AS quantity FROM lineitem)"""
EVC = EV + """, c AS (SELECT "window", key, CAST(sum(weight) AS BIGINT) AS cnt FROM ev GROUP BY ALL)"""
LIC = LI + """, c AS (SELECT "window", key, CAST(sum(weight) AS BIGINT) AS cnt FROM li GROUP BY ALL)"""
LIP = LI + """, p AS (SELECT "window", part, key, CAST(sum(weight) AS BIGINT) AS cnt FROM li GROUP BY ALL)"""


def totals(n: int) -> str:
    return f"""t AS (SELECT "window", CAST(sum(cnt) AS BIGINT) AS mass, CAST(sum(cnt) AS BIGINT) // {n} + 1 AS threshold FROM c GROUP BY ALL)"""


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


# Exact counts

HEAVY = f"""WITH {EVC}, {totals(100)} SELECT c."window", key, cnt, mass, threshold FROM c JOIN t USING ("window") WHERE cnt >= threshold"""


@register("exact_heavy_hitters_events", HEAVY)
def exact_heavy_hitters_events(spark, d):
    return exact.heavy_hitters(exact.global_counts(tables.events(spark, d)), 100)


@register("exact_heavy_hitters_weighted", f"""WITH {LI}, c AS (SELECT "window", key, CAST(sum(quantity) AS BIGINT) AS cnt FROM li WHERE quantity > 0 GROUP BY ALL), {totals(90)}
SELECT c."window", key, cnt, mass, threshold FROM c JOIN t USING ("window") WHERE cnt >= threshold""")
def exact_heavy_hitters_weighted(spark, d):
    return exact.heavy_hitters(exact.global_counts(tables.lineitem(spark, d, weighted=True)), 90)


@register("lenient_heavy_hitters", f"""WITH {LIC}, {totals(100)} SELECT c."window", key, cnt, mass, threshold FROM c JOIN t USING ("window") WHERE cnt * 100 >= mass""")
def lenient_heavy_hitters(spark, d):
    return exact.lenient_heavy_hitters(exact.global_counts(tables.lineitem(spark, d)), 100)


@register("local_exact_counts", f"""WITH {EV} SELECT "window", part, key, CAST(sum(weight) AS BIGINT) AS cnt FROM ev WHERE weight > 0 GROUP BY ALL""")
def local_exact_counts(spark, d):
    return exact.local_counts(tables.events(spark, d))


@register("top_k", f"""WITH {LIC}, r AS (SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY cnt DESC, key) AS rank FROM c) SELECT "window", key, cnt, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def top_k(spark, d):
    return exact.top_k(exact.global_counts(tables.lineitem(spark, d)), 10)


@register("most_common", f"""WITH {LIC} SELECT key, CAST(sum(cnt) AS BIGINT) AS cnt FROM c GROUP BY key ORDER BY cnt DESC, key LIMIT 25""")
def most_common(spark, d):
    return exact.most_common(exact.global_counts(tables.lineitem(spark, d)), 25)


@register("key_frequency", f"""WITH {LIP} SELECT "window", part, cnt, CAST(sum(cnt) OVER (PARTITION BY "window") AS BIGINT) AS total FROM p WHERE key = '7'""")
def key_frequency(spark, d):
    return exact.key_frequency(exact.local_counts(tables.lineitem(spark, d)), "7")


@register("top_n_churn", f"""WITH {LIC}, r AS (SELECT "window", key FROM (SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY cnt DESC, key DESC) AS rank FROM c) WHERE rank <= 20),
s AS (SELECT "window", count(*) AS size FROM r GROUP BY ALL),
x AS (SELECT b."window", count(*) AS shared FROM r a JOIN r b ON a."window" + 1 = b."window" AND a.key = b.key GROUP BY ALL),
y AS (SELECT s."window", s.size, o.size AS was, coalesce(x.shared, 0) AS shared FROM s JOIN s o ON o."window" + 1 = s."window" LEFT JOIN x ON x."window" = s."window")
SELECT "window", shared, size - shared AS replaced, round((size - shared) / size, 6) AS replacement, round(shared / (size + was - shared), 6) AS jaccard FROM y""")
def top_n_churn(spark, d):
    return rounded(exact.top_n_churn(exact.global_counts(tables.lineitem(spark, d)), 20), "replacement", "jaccard")


@register("trace_suitability", f"""WITH {LIC}, {totals(100)} SELECT c."window", any_value(mass) AS mass, count(*) AS keys, count(*) FILTER (WHERE cnt >= threshold) AS heavy,
count(*) FILTER (WHERE cnt * 100 >= mass * 0.8 AND cnt * 100 <= mass) AS near, round(CAST(sum(least(cnt, 8)) AS DOUBLE) / 8, 6) AS local_distinct FROM c JOIN t USING ("window") GROUP BY c."window" """)
def trace_suitability(spark, d):
    return rounded(exact.suitability(exact.global_counts(tables.lineitem(spark, d)), 100, 8), "local_distinct")


@register("partition_hardness", f"""WITH {LIP}, r AS (SELECT *, row_number() OVER (PARTITION BY "window", part ORDER BY cnt DESC, key) AS rank FROM p),
a AS (SELECT "window", part, count(*) AS keys, CAST(sum(cnt) AS BIGINT) AS load, coalesce(max(cnt) FILTER (WHERE rank = 5), 0) AS rank_n,
  coalesce(sum(cnt) FILTER (WHERE rank > 5), 0) AS b1, coalesce(sum(cnt) FILTER (WHERE rank > 10), 0) AS b2, coalesce(sum(cnt) FILTER (WHERE rank > 20), 0) AS b4 FROM r GROUP BY ALL),
x AS (SELECT "window", round(CAST(sum(keys) AS DOUBLE) / 8, 6) AS keys_mean, round(quantile_cont(keys, 0.95), 6) AS keys_p95, max(keys) AS keys_max, round(CAST(sum(load) AS DOUBLE) / 8, 6) AS load_mean,
  round(quantile_cont(load, 0.95), 6) AS load_p95, round(CAST(max(load) AS DOUBLE) * 8 / CAST(sum(load) AS DOUBLE), 6) AS load_max_over_mean, round(avg(rank_n), 6) AS rank_n_mean,
  round(CAST(sum(b1) AS DOUBLE) / CAST(sum(load) AS DOUBLE), 6) AS tail_mass_1n, round(CAST(sum(b2) AS DOUBLE) / CAST(sum(load) AS DOUBLE), 6) AS tail_mass_2n, round(CAST(sum(b4) AS DOUBLE) / CAST(sum(load) AS DOUBLE), 6) AS tail_mass_4n FROM a GROUP BY ALL),
k AS (SELECT "window", key, CAST(sum(cnt) AS BIGINT) AS cnt, count(*) AS support FROM p GROUP BY ALL),
m AS (SELECT *, CAST(sum(cnt) OVER (PARTITION BY "window") AS BIGINT) AS mass FROM k),
y AS (SELECT "window", count(*) FILTER (WHERE cnt * 5 >= mass) AS heavy, round(avg(support) FILTER (WHERE cnt * 5 >= mass), 6) AS heavy_support,
  round(avg(support) FILTER (WHERE cnt * 5 >= mass * 0.8 AND cnt * 5 < mass), 6) AS boundary_support, round(CAST(sum(cnt * support) AS DOUBLE) / CAST(sum(cnt) AS DOUBLE), 6) AS mass_support FROM m GROUP BY ALL)
SELECT * FROM x JOIN y USING ("window")""")
def partition_hardness(spark, d):
    out = exact.partition_hardness(exact.local_counts(tables.lineitem(spark, d)), 5, 8)
    return rounded(out, *[c for c in out.columns if c not in ("window", "keys_max", "heavy")])


# Windows

@register("tumbling_windows", """WITH e AS (SELECT epoch(ts) AS s, user_id FROM events), o AS (SELECT min(s) AS origin FROM e)
SELECT CAST(floor((s - origin) / 21600) AS BIGINT) AS "window", CAST(user_id AS VARCHAR) AS key, count(*) AS cnt FROM e, o GROUP BY ALL""")
def tumbling_windows(spark, d):
    t = spark.read.parquet(f"{d}/events.parquet").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    return windows.tumbling(t, F.col("s"), 21600.0).groupBy("window", F.col("user_id").cast("string").alias("key")).agg(F.count("*").alias("cnt"))


@register("ordered_windows_with_gaps", """WITH e AS (SELECT date_diff('minute', date_trunc('day', (SELECT min(ts) FROM events)), ts) // 3 AS w, event_type FROM events),
c AS (SELECT w, event_type, count(*) AS cnt FROM e GROUP BY ALL), g AS (SELECT unnest(range(0, (SELECT max(w) FROM c) + 1)) AS w)
SELECT CAST(g.w AS BIGINT) AS "window", event_type AS key, coalesce(cnt, 0) AS cnt FROM g LEFT JOIN c USING (w)""")
def ordered_windows_with_gaps(spark, d):
    """Every event, in windows of three minutes: so short that some have no event."""
    return windows.ordered_counts(spark.read.parquet(f"{d}/events.parquet"), "ts", "event_type", 0.05)


@register("first_events", f"""WITH {EV} SELECT "window", part, pos, key FROM ev ORDER BY pos LIMIT 500""")
def first_events(spark, d):
    return windows.first_events(tables.events(spark, d), 500).select("window", "part", "pos", "key")


@register("window_slice", f"""WITH {EVC}, o AS (SELECT min("window") AS w FROM c) SELECT "window" - w - 5 AS "window", key, cnt, "window" AS source_window FROM c, o WHERE "window" BETWEEN w + 5 AND w + 14""")
def window_slice(spark, d):
    counts = exact.global_counts(tables.events(spark, d))
    first = counts.agg(F.min("window")).first()[0]
    return windows.slice_windows(counts, first + 5, 10)


@register("trace_concat", f"""WITH {EVC}, o AS (SELECT "window", row_number() OVER (ORDER BY "window") - 1 AS w FROM (SELECT DISTINCT "window" FROM c)), n AS (SELECT count(*) AS n FROM o)
SELECT CAST(w AS BIGINT) AS "window", key, cnt, 'a' AS source_profile, c."window" AS source_window FROM c JOIN o USING ("window")
UNION ALL SELECT CAST(w + n AS BIGINT), key, cnt, 'b', c."window" FROM c JOIN o USING ("window"), n""")
def trace_concat(spark, d):
    counts = exact.global_counts(tables.events(spark, d))
    return windows.concat_traces({"a": counts, "b": counts})


@register("partition_collapse", f"""WITH {LIC} SELECT * FROM c""")
def partition_collapse(spark, d):
    return windows.collapse_partitions(exact.local_counts(tables.lineitem(spark, d)))


@register("window_reindex", f"""WITH {LIC}, o AS (SELECT "window" AS w, row_number() OVER (ORDER BY "window") - 1 AS i FROM (SELECT DISTINCT "window" FROM c))
SELECT CAST("window" AS VARCHAR) AS label, key, cnt, CAST(i AS BIGINT) AS "window" FROM c JOIN o ON w = c."window" """)
def window_reindex(spark, d):
    return windows.reindex_windows(exact.global_counts(tables.lineitem(spark, d)).withColumn("label", F.col("window").cast("string")))


@register("count_validation", f"""WITH {EVC}, k AS (SELECT "window", key, count(*) AS rows, min(cnt) AS least FROM c GROUP BY ALL),
o AS (SELECT count(*) FILTER (WHERE least <= 0 OR least IS NULL) AS bad_counts, count(*) FILTER (WHERE rows > 1) AS repeated_keys, count(*) FILTER (WHERE key IS NULL) AS null_keys, coalesce(min("window"), 0) AS first_window,
 coalesce(max("window") - min("window") + 1, 0) - count(DISTINCT "window") AS missing_windows FROM k)
SELECT *, bad_counts + repeated_keys + null_keys + missing_windows = 0 AND first_window = 0 AS valid FROM o""")
def count_validation(spark, d):
    return windows.validate_counts(exact.global_counts(tables.events(spark, d)))


# Local summaries and their reduction

def ss_fold(q: int, source: str) -> str:
    """Space-Saving in SQL: a fold over lists of counters; an event is a list of one."""
    counter = "{'k': key, 'c': weight, 'e': CAST(0 AS BIGINT), 't': pos}"
    return f"""f AS (SELECT "window", part, CAST(sum(weight) AS BIGINT) AS n_local, list_reduce(list([{counter}] ORDER BY pos), lambda a, b:
  CASE WHEN list_contains(list_transform(a, lambda z: z.k), b[1].k)
       THEN list_transform(a, lambda z: CASE WHEN z.k = b[1].k THEN {{'k': z.k, 'c': z.c + b[1].c, 'e': z.e, 't': b[1].t}} ELSE z END)
       WHEN len(a) < {q} THEN list_concat(a, b)
       ELSE list_transform(a, lambda z: CASE WHEN z.t = list_sort(list_transform(a, lambda y: {{'c': y.c, 't': y.t}}))[1].t THEN {{'k': b[1].k, 'c': z.c + b[1].c, 'e': z.c, 't': b[1].t}} ELSE z END) END) AS s
  FROM {source} WHERE weight > 0 GROUP BY ALL),
rep AS (SELECT "window", part, n_local, CAST({q} AS BIGINT) AS q_local, u.k AS key, CAST(u.c AS BIGINT) AS est, CAST(u.e AS BIGINT) AS eps FROM (SELECT "window", part, n_local, unnest(s) AS u FROM f))"""


def certify_sql(n: int, reports: str = "rep") -> str:
    return f"""least AS (SELECT "window", part, any_value(n_local) AS n_local, CASE WHEN count(*) >= any_value(q_local) THEN min(est) ELSE 0 END AS fl FROM {reports} GROUP BY ALL),
tot AS (SELECT "window", CAST(sum(n_local) AS BIGINT) AS mass, CAST(sum(n_local) AS BIGINT) // {n} + 1 AS threshold, CAST(sum(fl) AS BIGINT) AS floors FROM least GROUP BY ALL),
it AS (SELECT r."window", key AS id, CAST(sum(est) AS BIGINT) AS est, CAST(sum(eps) AS BIGINT) AS inflation, count(*) AS reporters, CAST(sum(r.n_local) AS BIGINT) AS seen, CAST(sum(fl) AS BIGINT) AS own, min(r.part) AS resolution_part
  FROM {reports} r JOIN least USING ("window", part) GROUP BY ALL),
cert AS (SELECT "window", id, est, reporters, seen / mass AS omega, greatest(0, est - inflation) AS cert_lb, est + greatest(0, floors - own) AS cert_ub, inflation, greatest(0, floors - own) AS hidden, resolution_part, mass, threshold FROM it JOIN tot USING ("window"))"""


SS = f"""WITH {EV}, {ss_fold(10, "ev")}"""


@register("space_saving_report", SS + """ SELECT * FROM rep""")
def space_saving_report(spark, d):
    return sketches.space_saving(tables.events(spark, d), 10)


@register("space_saving_frequent", SS + """, g AS (SELECT "window", part, key, est, eps, ceil(0.05 * n_local) AS least FROM rep)
SELECT "window", part, key, est, bool_and(est - eps >= least) OVER (PARTITION BY "window", part) AS guaranteed FROM g WHERE est >= least""")
def space_saving_frequent(spark, d):
    return sketches.frequent(sketches.space_saving(tables.events(spark, d), 10), 0.05)


@register("space_saving_top", SS + """, g AS (SELECT *, row_number() OVER w AS rank, coalesce(lead(est) OVER w, 0) AS next FROM rep WINDOW w AS (PARTITION BY "window", part ORDER BY est DESC, key)),
h AS (SELECT *, coalesce(max(est) FILTER (WHERE rank = 6) OVER (PARTITION BY "window", part), 0) AS lim FROM g)
SELECT "window", part, CAST(rank AS INTEGER) AS rank, key, est, bool_and(est - eps >= lim) OVER (PARTITION BY "window", part) AS guaranteed, bool_and(est - eps >= next) OVER (PARTITION BY "window", part) AS ordered FROM h WHERE rank <= 5""")
def space_saving_top(spark, d):
    return sketches.top_reports(sketches.space_saving(tables.events(spark, d), 10), 5)


@register("certified_global", SS + f""", {certify_sql(20)} SELECT "window", id, est, reporters, round(omega, 6) AS omega, cert_lb, cert_ub, inflation, hidden, resolution_part, cert_lb >= threshold AS guaranteed, mass, threshold FROM cert WHERE cert_ub >= threshold""")
def certified_global(spark, d):
    return rounded(reduce.certify(*reduce.from_sketch(sketches.space_saving(tables.events(spark, d), 10)), 20), "omega")


CHECKS = SS + f""", {certify_sql(20)}, k AS (SELECT "window", key, count(*) AS cnt FROM ev GROUP BY ALL)"""


@register("certificate_invariants", CHECKS + """, j AS (SELECT k."window", k.cnt, cert.id, cert_lb, cert_ub, floors FROM k LEFT JOIN cert ON cert."window" = k."window" AND cert.id = k.key JOIN tot ON tot."window" = k."window")
SELECT "window", count(*) AS keys, count(id) AS reported, CAST(sum(cert_ub - cert_lb) AS BIGINT) AS width, count(*) FILTER (WHERE id IS NOT NULL AND (cnt < cert_lb OR cnt > cert_ub)) AS broken, count(*) FILTER (WHERE id IS NULL AND cnt > floors) AS unseen_broken FROM j GROUP BY ALL""")
def certificate_invariants(spark, d):
    """Every exact count lies in its certified interval, and an unreported key is below the sum of the least counters."""
    ev = tables.events(spark, d)
    parts, reports = reduce.from_sketch(sketches.space_saving(ev, 10))
    items = reduce.certify(parts, reports, 20, prune=False)
    unseen = reduce.window_summary(parts, reports, 20).select("window", "unseen_ub")
    both = exact.global_counts(ev).withColumnRenamed("key", "id").join(items.select("window", "id", "cert_lb", "cert_ub"), ["window", "id"], "left").join(unseen, "window")
    inside = (F.col("cnt") >= F.col("cert_lb")) & (F.col("cnt") <= F.col("cert_ub"))
    return both.groupBy("window").agg(F.count("*").alias("keys"), F.count("cert_lb").alias("reported"), F.sum(F.col("cert_ub") - F.col("cert_lb")).alias("width"), F.count_if(~inside).alias("broken"), F.count_if(F.col("cert_lb").isNull() & (F.col("cnt") > F.col("unseen_ub"))).alias("unseen_broken"))


@register("window_summary", SS + f""", {certify_sql(20)} SELECT "window", mass, threshold, floors AS unseen_ub, floors < threshold AS complete FROM tot""")
def window_summary(spark, d):
    return reduce.window_summary(*reduce.from_sketch(sketches.space_saving(tables.events(spark, d), 10)), 20)


# Bucketed sketches: merging exact cells, the largest 3 of each partition's bucket

CELLS = LIP + """, b AS (SELECT *, CAST(CAST('0x' || substr(md5(key), 1, 8) AS BIGINT) % 16 AS INTEGER) AS bucket FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY "window", part, bucket ORDER BY cnt DESC, key) AS rank FROM b),
cells AS (SELECT "window", part, bucket, key AS id, cnt AS est, cnt AS lb FROM r WHERE rank <= 3),
res AS (SELECT "window", bucket, CAST(coalesce(sum(cnt) FILTER (WHERE rank > 3), 0) AS BIGINT) AS residual FROM r GROUP BY ALL),
tot AS (SELECT "window", CAST(sum(cnt) AS BIGINT) AS mass, CAST(sum(cnt) AS BIGINT) // 50 + 1 AS threshold FROM p GROUP BY ALL),
mg AS (SELECT "window", bucket, id, CAST(sum(est) AS BIGINT) AS est, CAST(sum(lb) AS BIGINT) AS lb, count(DISTINCT part) AS reporters, min(part) AS resolution_part FROM cells GROUP BY ALL),
rk AS (SELECT mg.*, row_number() OVER (PARTITION BY "window", bucket ORDER BY est DESC, id) AS rank, mass, threshold, least(mass, lb + residual) AS ub, residual FROM mg JOIN tot USING ("window") JOIN res USING ("window", bucket))"""


def exact_cells(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    local = exact.local_counts(tables.lineitem(spark, d)).withColumn("bucket", bucket_of(F.col("key"), 16))
    ranked = held(local.withColumn("rank", F.row_number().over(Window.partitionBy("window", "part", "bucket").orderBy(F.desc("cnt"), "key"))))  # three branches read it
    cells = ranked.filter("rank <= 3").select("window", "part", "bucket", F.col("key").alias("id"), F.col("cnt").alias("est"), F.col("cnt").alias("lb"))
    residuals = ranked.groupBy("window", "part", "bucket").agg(F.coalesce(F.sum(F.when(F.col("rank") > 3, F.col("cnt"))), F.lit(0)).alias("residual"))
    return cells, residuals, ranked.groupBy("window", "part").agg(F.sum("cnt").alias("n_local"))


@register("bucket_reduce_items", f"""WITH {CELLS} SELECT "window", id, bucket, est, reporters, lb AS cert_lb, ub AS cert_ub, resolution_part, lb >= threshold AS guaranteed, mass, threshold FROM rk WHERE rank <= 4""")
def bucket_reduce_items(spark, d):
    cells, residuals, parts = exact_cells(spark, d)
    return reduce.reduce_buckets(cells, 50, 4, residuals, parts)[0]


@register("bucket_reduce_summary", f"""WITH {CELLS}, l AS (SELECT "window", max(residual) AS largest FROM res GROUP BY ALL), dr AS (SELECT "window", max(ub) FILTER (WHERE rank > 4) AS dropped FROM rk GROUP BY ALL)
SELECT tot."window", mass, threshold, greatest(largest, coalesce(dropped, 0)) AS unseen_ub, greatest(largest, coalesce(dropped, 0)) < threshold AS complete FROM tot JOIN l USING ("window") JOIN dr USING ("window")""")
def bucket_reduce_summary(spark, d):
    cells, residuals, parts = exact_cells(spark, d)
    return reduce.reduce_buckets(cells, 50, 4, residuals, parts)[1]


@register("locked_bucket_mass", f"""WITH {LIP} SELECT "window", part, CAST(CAST('0x' || substr(md5(key), 1, 8) AS BIGINT) % 16 AS INTEGER) AS bucket, CAST(sum(cnt) AS BIGINT) AS mass FROM p GROUP BY ALL""")
def locked_bucket_mass(spark, d):
    """What the cells of each bucket surely hold, with its residual: that is its whole mass."""
    cells = sketches.locked_buckets(tables.lineitem(spark, d), 16, depth=4, theta=0.05)
    return cells.groupBy("window", "part", "bucket").agg((F.sum("lb") + F.max("residual")).alias("mass"))


@register("locked_bucket_bounds", f"""WITH {LIP} SELECT "window", part, count(*) AS keys, CAST(sum(cnt) AS BIGINT) AS mass FROM p GROUP BY ALL""")
def locked_bucket_bounds(spark, d):
    """Keys, and their mass, whose exact count lies between the bounds that the sketch gives for it."""
    li = tables.lineitem(spark, d)
    cells = sketches.locked_buckets(li, 16, depth=4, theta=0.05)
    counts = exact.local_counts(li).withColumn("bucket", bucket_of(F.col("key"), 16))
    rest = cells.groupBy("window", "part", "bucket").agg(F.max("residual").alias("residual"))
    both = counts.join(rest, ["window", "part", "bucket"]).join(cells.select("window", "part", "key", "lb"), ["window", "part", "key"], "left")
    low = F.coalesce("lb", F.lit(0))
    return both.filter((F.col("cnt") >= low) & (F.col("cnt") <= low + F.col("residual"))).groupBy("window", "part").agg(F.count("*").alias("keys"), F.sum("cnt").alias("mass"))


@register("locked_bucket_certified")
def locked_bucket_certified(spark, d):
    cells = held(sketches.locked_buckets(tables.lineitem(spark, d), 32))
    residuals = cells.select("window", "part", "bucket", "residual").distinct()
    parts = cells.groupBy("window", "part").agg(F.max("n_local").alias("n_local"))
    return reduce.reduce_buckets(cells.withColumnRenamed("key", "id"), 100, 6, residuals, parts)[0]


@register("cuckoo_report")
def cuckoo_report(spark, d):
    return sketches.cuckoo_keeper(tables.events(spark, d), 16)


@register("approximate_top")
def approximate_top(spark, d):
    return sketches.approximate_top(tables.events(spark, d), 10)


# Exact head and tail

HEAD = f"""h AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS slot FROM (SELECT key, count(*) AS n FROM ev GROUP BY key ORDER BY n DESC, key LIMIT 20))"""
HYBRID = f"""WITH {EV}, {HEAD}, tail AS (SELECT ev.* FROM ev ANTI JOIN h USING (key)), {ss_fold(8, "tail")},
ex AS (SELECT "window", part, key, count(*) AS est FROM ev JOIN h USING (key) GROUP BY ALL),
pm AS (SELECT "window", part, count(*) AS n_local, count(*) FILTER (WHERE key IN (SELECT key FROM h)) AS head_mass FROM ev GROUP BY ALL),
lst AS (SELECT "window", part, CASE WHEN count(*) >= 8 THEN min(est) ELSE 0 END AS fl FROM rep GROUP BY ALL),
tot AS (SELECT "window", CAST(sum(n_local) AS BIGINT) AS mass, CAST(sum(n_local) AS BIGINT) // 40 + 1 AS threshold, CAST(sum(coalesce(fl, 0)) AS BIGINT) AS floors FROM pm LEFT JOIN lst USING ("window", part) GROUP BY ALL),
both_ AS (SELECT "window", part, key AS id, est, 0 AS eps, TRUE AS head FROM ex UNION ALL SELECT "window", part, key, est, eps, FALSE FROM rep),
it AS (SELECT b."window", id, CAST(sum(est) AS BIGINT) AS est, CAST(sum(eps) AS BIGINT) AS inflation, bool_or(head) AS head, CAST(sum(coalesce(fl, 0)) AS BIGINT) AS own FROM both_ b LEFT JOIN lst USING ("window", part) GROUP BY ALL),
ce AS (SELECT "window", id, est, CASE WHEN head THEN est ELSE greatest(0, est - inflation) END AS cert_lb, CASE WHEN head THEN est ELSE est + greatest(0, floors - own) END AS cert_ub, mass, threshold FROM it JOIN tot USING ("window"))"""


def frequent_users(spark: SparkSession, d: str, size: int = 20) -> list[str]:
    """The dictionary of the hybrid queries: `size` keys at most, whatever the input."""
    top = exact.most_common(exact.global_counts(tables.events(spark, d)), size)
    return [r.key for r in top.collect()]


def hybrid_items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    head = hybrid.Head.install(frequent_users(spark, d), 20, 1)
    return hybrid.hybrid_report(tables.events(spark, d), head.frame(spark), 8, 1)


@register("hybrid_published", HYBRID + """ SELECT "window", id, est, cert_lb, cert_ub, mass, threshold FROM ce WHERE cert_ub >= threshold""")
def hybrid_published(spark, d):
    return reduce.coordinated(*hybrid_items(spark, d), 40, 10)["published"].select("window", "id", "est", "cert_lb", "cert_ub", "mass", "threshold")


@register("hybrid_residual", HYBRID + """ SELECT "window", id, est, cert_lb, cert_ub FROM ce WHERE cert_ub >= threshold AND id NOT IN (SELECT key FROM h)""")
def hybrid_residual(spark, d):
    return reduce.coordinated(*hybrid_items(spark, d), 40, 10)["residual"].select("window", "id", "est", "cert_lb", "cert_ub")


@register("hybrid_top", HYBRID + """, r AS (SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY est DESC, id) AS rank FROM ce) SELECT "window", id, est, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def hybrid_top(spark, d):
    return reduce.coordinated(*hybrid_items(spark, d), 40, 10)["top"].select("window", "id", "est", "rank")


@register("head_share", HYBRID + """ SELECT "window", round(min(head_mass / n_local), 6) AS share FROM pm GROUP BY ALL""")
def head_share(spark, d):
    return rounded(hybrid.least_head_share(hybrid_items(spark, d)[0]), "share")


@register("head_selection", SS + f""", {certify_sql(20)}, r AS (SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY est DESC, id) AS rk FROM cert) SELECT "window", id FROM r WHERE rk <= 20 OR cert_ub >= threshold""")
def head_selection(spark, d):
    items = reduce.certify(*reduce.from_sketch(sketches.space_saving(tables.events(spark, d), 10)), 20, prune=False)
    return hybrid.select_head(items, "topn-frontier", 20)


@register("head_changes", f"""WITH {EVC}, w AS (SELECT "window", row_number() OVER (ORDER BY "window") AS g FROM (SELECT DISTINCT "window" FROM c)),
r AS (SELECT "window", g, key AS id FROM (SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY cnt DESC, key) AS rk FROM c) JOIN w USING ("window") WHERE rk <= 20),
x AS (SELECT coalesce(a.g, b.g + 1) AS g, count(*) FILTER (WHERE a.id IS NOT NULL AND b.id IS NOT NULL) AS kept, count(*) FILTER (WHERE a.id IS NULL) AS removed, count(*) FILTER (WHERE b.id IS NULL) AS added
 FROM r a FULL JOIN r b ON a.g = b.g + 1 AND a.id = b.id GROUP BY ALL),
y AS (SELECT "window", g, kept, removed, added, (40 + (kept + added) * 16) * 4 AS full_bytes, (40 + removed * 4 + added * 16) * 4 AS delta_bytes FROM x JOIN w USING (g))
SELECT "window", kept, removed, added, full_bytes, delta_bytes, g > 1 AND g % 32 > 0 AND delta_bytes <= full_bytes * 0.8 AS selected FROM y""")
def head_changes(spark, d):
    heads = exact.top_k(exact.global_counts(tables.events(spark, d)), 20).select("window", F.col("key").alias("id"))
    return hybrid.head_changes(heads, partitions=4)


# Quality

EVAL = SS + f""", {certify_sql(60)}, {EVC.split(', c AS')[1].join(['c AS', ''])}, tt AS (SELECT "window", CAST(sum(cnt) AS BIGINT) // 60 + 1 AS t FROM c GROUP BY ALL),
j AS (SELECT coalesce(c."window", x."window") AS "window", cnt, est, coalesce(cnt >= t, FALSE) AS heavy, coalesce(est >= threshold, FALSE) AS said FROM (SELECT * FROM c JOIN tt USING ("window")) c FULL JOIN cert x ON c."window" = x."window" AND c.key = x.id),
e AS (SELECT "window", count(*) FILTER (WHERE heavy AND said) AS tp, count(*) FILTER (WHERE NOT heavy AND said) AS fp, count(*) FILTER (WHERE heavy AND NOT said) AS fn, count(*) FILTER (WHERE heavy) AS heavy,
 CAST(coalesce(sum(abs(coalesce(est, 0) - cnt)) FILTER (WHERE heavy), 0) AS BIGINT) AS abs_error, coalesce(sum(abs(coalesce(est, 0) - cnt) / cnt) FILTER (WHERE heavy), 0) AS rel_error FROM j GROUP BY ALL)"""
SCORES = """CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS r"""
ROUNDED = """round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1,
round(CASE WHEN heavy > 0 THEN abs_error / heavy ELSE 0.0 END, 6) AS aae, round(CASE WHEN heavy > 0 THEN rel_error / heavy ELSE 0.0 END, 6) AS "are" """


def evaluated(spark: SparkSession, d: str, k: int | None = None) -> DataFrame:
    ev = tables.events(spark, d)
    items = reduce.certify(*reduce.from_sketch(sketches.space_saving(ev, 10)), 60, prune=False)
    return metrics.evaluate(exact.global_counts(ev).withColumnRenamed("key", "id"), items, 60, k)


@register("evaluate_windows", EVAL + f""", ra AS (SELECT "window", key AS id, row_number() OVER (PARTITION BY "window" ORDER BY cnt DESC, key) AS k FROM c), rb AS (SELECT "window", id, row_number() OVER (PARTITION BY "window" ORDER BY est DESC, id) AS k FROM cert),
ov AS (SELECT ra."window", count(rb.id) / 10 AS overlap FROM ra LEFT JOIN rb ON ra."window" = rb."window" AND ra.id = rb.id AND rb.k <= 10 WHERE ra.k <= 10 GROUP BY ALL)
SELECT "window", tp, fp, fn, heavy, abs_error, round(rel_error, 6) AS rel_error, {ROUNDED}, round(overlap, 6) AS overlap FROM (SELECT *, {SCORES} FROM e JOIN ov USING ("window"))""")
def evaluate_windows(spark, d):
    return rounded(evaluated(spark, d, 10), "rel_error", "precision", "recall", "f1", "aae", "are", "overlap")


@register("pooled_quality", EVAL + f""" SELECT tp, fp, fn, heavy, abs_error, round(rel_error, 6) AS rel_error, windows, {ROUNDED} FROM (SELECT *, {SCORES} FROM (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
CAST(sum(heavy) AS BIGINT) AS heavy, CAST(sum(abs_error) AS BIGINT) AS abs_error, sum(rel_error) AS rel_error, count(*) AS windows FROM e WHERE "window" > (SELECT min("window") FROM e)))""")
def pooled_quality(spark, d):
    return rounded(metrics.pooled(metrics.without_warm_up(evaluated(spark, d))), "rel_error", "precision", "recall", "f1", "aae", "are")


@register("certification_metrics", EVAL + """, hv AS (SELECT c."window", c.key FROM c JOIN tt USING ("window") WHERE cnt >= t), fo AS (SELECT hv."window", count(cert.id) / count(*) AS candidate_recall FROM hv LEFT JOIN cert ON cert."window" = hv."window" AND cert.id = hv.key GROUP BY ALL),
q AS (SELECT *, cert_lb >= threshold AS yes, cert_ub < threshold AS no, (cert_ub - cert_lb) / mass AS width FROM cert)
SELECT q."window", count(*) FILTER (WHERE yes) AS certified_heavy, count(*) FILTER (WHERE NOT yes AND NOT no) AS ambiguous, count(*) FILTER (WHERE no) AS certified_light, CAST(coalesce(sum(est) FILTER (WHERE yes), 0) AS BIGINT) AS heavy_mass,
CAST(coalesce(sum(est) FILTER (WHERE NOT yes AND NOT no), 0) AS BIGINT) AS ambiguous_mass, CAST(coalesce(sum(est) FILTER (WHERE no), 0) AS BIGINT) AS light_mass, round(avg(width), 6) AS width_mean, round(avg(width) FILTER (WHERE NOT yes AND NOT no), 6) AS ambiguous_width_mean,
round(max(width), 6) AS width_max, round(coalesce(any_value(candidate_recall), 1.0), 6) AS candidate_recall FROM q LEFT JOIN fo ON fo."window" = q."window" GROUP BY q."window" """)
def certification_metrics(spark, d):
    ev = tables.events(spark, d)
    items = reduce.certify(*reduce.from_sketch(sketches.space_saving(ev, 10)), 60, prune=False)
    return rounded(metrics.certification(exact.global_counts(ev).withColumnRenamed("key", "id"), items, 60), "width_mean", "ambiguous_width_mean", "width_max", "candidate_recall")


@register("service_margin", SS + f""", {certify_sql(20)}, m AS (SELECT "window", greatest(inflation, hidden) / mass AS margin FROM cert WHERE cert_ub >= threshold) SELECT "window", round(quantile_disc(margin, 0.95), 9) AS margin FROM m GROUP BY ALL""")
def service_margin(spark, d):
    items = reduce.certify(*reduce.from_sketch(sketches.space_saving(tables.events(spark, d), 10)), 20)
    m = items.select("window", (F.greatest("inflation", "hidden") / F.col("mass")).alias("m"))
    return rounded(nearest_rank(m, ["window"], "m", 0.95, "margin"), "margin", digits=9)


@register("truncated_quantile", f"""WITH {LIC}, r AS (SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY cnt) - 1 AS i, count(*) OVER (PARTITION BY "window") AS n FROM c) SELECT "window", cnt AS p90 FROM r WHERE i = floor(0.9 * (n - 1))""")
def truncated_quantile(spark, d):
    return truncated_rank(exact.global_counts(tables.lineitem(spark, d)), ["window"], "cnt", 0.9, "p90")


@register("count_ecdf", f"""WITH {LIC} SELECT "window", key, cnt, round(cume_dist() OVER (PARTITION BY "window" ORDER BY cnt), 9) AS share FROM c""")
def count_ecdf(spark, d):
    return rounded(metrics.ecdf(exact.global_counts(tables.lineitem(spark, d)), ("window",), "cnt"), "share", digits=9)


@register("pareto_frontier", """WITH x AS (SELECT p_size AS cost, p_retailprice AS quality, p_partkey FROM part) SELECT a.cost, a.quality, a.p_partkey FROM x a WHERE NOT EXISTS (SELECT 1 FROM x b WHERE b.cost <= a.cost AND b.quality >= a.quality AND (b.cost < a.cost OR b.quality > a.quality))""")
def pareto_frontier(spark, d):
    points = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_size").alias("cost"), F.col("p_retailprice").alias("quality"), "p_partkey")
    return metrics.pareto(points, "cost", "quality")


@register("communication_model", SS + """ SELECT "window", part, 32 + count(*) * 24 AS bytes FROM rep GROUP BY ALL""")
def communication_model(spark, d):
    return metrics.communication(*reduce.from_sketch(sketches.space_saving(tables.events(spark, d), 10)))


@register("systems_summary", f"""WITH {LI}, e AS (SELECT 'a' AS method, part AS m, CAST(CAST('0x' || substr(md5(key), 1, 8) AS BIGINT) % 5 AS INTEGER) AS repetition, "window" - 23000 AS w, CAST(count(*) AS DOUBLE) AS ms, count(*) * 1000 AS ev FROM li GROUP BY ALL),
r AS (SELECT method, m, repetition, avg(ms) AS mean, quantile_cont(ms, 0.5) AS p50, quantile_cont(ms, 0.95) AS p95, sum(ev) / sum(ms) / 1000 AS mevents_s FROM e WHERE w > 0 GROUP BY ALL)
SELECT method, m, round(median(mean), 6) AS mean, round(quantile_cont(mean, 0.75) - quantile_cont(mean, 0.25), 6) AS mean_iqr, round(median(p50), 6) AS p50, round(quantile_cont(p50, 0.75) - quantile_cont(p50, 0.25), 6) AS p50_iqr,
round(median(p95), 6) AS p95, round(quantile_cont(p95, 0.75) - quantile_cont(p95, 0.25), 6) AS p95_iqr, round(CAST(median(mevents_s) AS DOUBLE), 6) AS mevents_s, round(CAST(quantile_cont(mevents_s, 0.75) - quantile_cont(mevents_s, 0.25) AS DOUBLE), 6) AS mevents_s_iqr FROM r GROUP BY ALL""")
def systems_summary(spark, d):
    """The summary of repeated timings, over counts in their place: a key's hash gives its repetition, so every key is in one of five."""
    li = tables.lineitem(spark, d).withColumn("repetition", bucket_of(F.col("key"), 5))
    times = li.groupBy(F.lit("a").alias("method"), F.col("part").alias("m"), "repetition", (F.col("window") - 23000).alias("window")).agg(F.count("*").cast("double").alias("ms"), (F.count("*") * 1000).alias("events"))
    out = metrics.systems_summary(times)
    return rounded(out, *[c for c in out.columns if c not in ("method", "m")])


@register("phase_masses", f"""WITH {LIC}, t AS (SELECT *, CAST(sum(cnt) OVER (PARTITION BY "window") AS BIGINT) AS mass FROM c), w AS (SELECT "window", any_value(mass) AS mass, count(*) AS keys, count(*) FILTER (WHERE cnt * 100 > mass) AS heavy,
 count(*) FILTER (WHERE cnt >= (mass // 100 + 1) * 0.8 AND cnt <= mass // 100 + 1) AS near FROM t GROUP BY ALL), ph AS (SELECT *, CASE WHEN "window" < 23950 THEN 'before' WHEN "window" < 23980 THEN 'early' ELSE 'late' END AS phase FROM w)
SELECT phase, min(mass) AS mass_min, max(mass) AS mass_max, round(avg(keys), 6) AS keys_mean, round(avg(heavy), 6) AS heavy_mean, min(heavy) AS heavy_min, max(heavy) AS heavy_max, round(avg(near), 6) AS near_mean FROM ph GROUP BY ALL""")
def phase_masses(spark, d):
    """All windows, from the first to the last: before, early, and late to the end of the data."""
    counts = exact.global_counts(tables.lineitem(spark, d))
    last = counts.agg(F.max("window")).first()[0] or 0
    steps = spark.createDataFrame([(1, "before", 23950), (2, "early", 30), (3, "late", max(1, last + 1 - 23980))], "step int, phase string, duration int")
    return rounded(metrics.mass_by_phase(counts, metrics.timeline(steps), 100), "keys_mean", "heavy_mean", "near_mean")


@register("key_resolution", SS + f""", {certify_sql(60)} SELECT "window", md5(id) AS id, est, resolution_part, id AS key FROM cert WHERE est >= threshold""")
def key_resolution(spark, d):
    """Reports by identity only; the keys of what is published come from the partition that resolves each."""
    sketch = held(sketches.space_saving(tables.events(spark, d), 10)).withColumn("id", key_id(F.col("key")))
    items = reduce.certify(*reduce.from_sketch(sketch.withColumn("key", F.col("id")), hold=False), 60)
    return reduce.resolve_keys(items, sketch.select("window", "part", "id", "key")).select("window", "id", "est", "resolution_part", "key")


@register("expanded_events", f"""WITH {EV}, k AS (SELECT "window", part, key, CAST(sum(weight) AS BIGINT) AS events FROM ev GROUP BY ALL) SELECT *, CAST(sum(events) OVER (PARTITION BY "window", part) AS BIGINT) - 1 AS last_pos FROM k""")
def expanded_events(spark, d):
    """Counts expanded to shuffled events and counted again, with the last place of their partition."""
    out = streams.expand(exact.local_counts(tables.events(spark, d)), seed=5)
    last = out.groupBy("window", "part").agg(F.max("pos").alias("last_pos"))
    return out.groupBy("window", "part", "key").agg(F.sum("weight").alias("events")).join(last, ["window", "part"])


# Placement

@register("place_round_robin", f"""WITH {LIC}, s AS (SELECT *, CAST('0x' || substr(md5('3|' || key), 1, 8) AS BIGINT) % 8 AS start, unnest(range(0, 8)) AS i FROM c)
SELECT "window", CAST((start + i) % 8 AS INTEGER) AS part, key, cnt // 8 + CASE WHEN i < cnt % 8 THEN 1 ELSE 0 END AS cnt FROM s WHERE cnt // 8 + CASE WHEN i < cnt % 8 THEN 1 ELSE 0 END > 0""")
def place_round_robin(spark, d):
    return placement.round_robin(exact.global_counts(tables.lineitem(spark, d)), 8, seed=3)


@register("place_source_prefix_locality", f"""WITH {EVC} SELECT "window", CAST(CAST('0x' || substr(md5('17|' || key), 1, 8) AS BIGINT) % 8 AS INTEGER) AS part, key, cnt FROM c""")
def place_source_prefix_locality(spark, d):
    return placement.place(exact.global_counts(tables.events(spark, d)), 8, "source_prefix_locality", seed=17)


@register("place_certificate_stress", f"""WITH {EVC}, h AS (SELECT *, CAST(sum(cnt) OVER (PARTITION BY "window") AS BIGINT) AS mass, CAST('0x' || substr(md5('17|' || key), 1, 8) AS BIGINT) AS a, CAST('0x' || substr(md5('17|few|' || key), 1, 8) AS BIGINT) AS b FROM c),
k AS (SELECT *, CASE WHEN cnt * 60 >= mass * 0.8 AND cnt * 60 <= mass * 1.2 THEN 3 ELSE 8 END AS m FROM h),
s AS (SELECT *, unnest(range(0, m)) AS i FROM k)
SELECT "window", CAST((CASE WHEN m = 3 THEN (a + i) % 3 + b % 8 ELSE a + i END) % 8 AS INTEGER) AS part, key, cnt // m + CASE WHEN i < cnt % m THEN 1 ELSE 0 END AS cnt FROM s WHERE cnt // m + CASE WHEN i < cnt % m THEN 1 ELSE 0 END > 0""")
def place_certificate_stress(spark, d):
    return placement.place(exact.global_counts(tables.events(spark, d)), 8, "certificate_stress", n=60, seed=17)


def _placement(policy: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        """Each key's count, added up again over the partitions that it was placed on."""
        return windows.collapse_partitions(placement.place(exact.global_counts(tables.events(spark, d)), 8, policy, n=60, seed=17))

    return run


for _policy in ("synthetic_mixture", "persistent_locality", "imbalance", *placement.ADVERSARIES):
    register(f"place_{_policy}", f"""WITH {EVC} SELECT "window", key, cnt FROM c""")(_placement(_policy))


@register("placement_visibility")
def placement_visibility(spark, d):
    """Of each policy and window: the largest load over the mean, and the share of the heavy keys' mass that a partition would report."""
    counts, out = exact.global_counts(tables.events(spark, d)), None
    heavy = exact.heavy_hitters(counts, 60).select("window", "key")
    for policy in ("round_robin", *placement.ADVERSARIES):
        placed = placement.place(counts, 8, policy, n=60, seed=17)
        loads = placed.groupBy("window", "part").agg(F.sum("cnt").alias("load"))
        size = loads.groupBy("window").agg((F.max("load") * 8 / F.sum("load")).alias("load_max_over_mean"))
        mine = placed.join(heavy, ["window", "key"]).join(loads, ["window", "part"])
        shown = mine.groupBy("window").agg((F.sum(F.when(F.col("cnt") * 60 >= F.col("load"), F.col("cnt")).otherwise(0)) / F.sum("cnt")).alias("visible"))
        one = size.join(shown, "window", "left").select(F.lit(policy).alias("policy"), "window", "load_max_over_mean", "visible")
        out = one if out is None else out.unionByName(one)
    return out


@register("counts_preserved", f"""WITH {EVC} SELECT "window", count(*) AS keys, CAST(sum(cnt) AS BIGINT) AS mass FROM c GROUP BY ALL""")
def counts_preserved(spark, d):
    """Keys and mass that a placement keeps: those that the check of counts does not find changed."""
    counts = exact.global_counts(tables.events(spark, d))
    changed = windows.preserved(counts, placement.round_robin(counts, 5))
    return counts.join(changed.select("window", "key"), ["window", "key"], "left_anti").groupBy("window").agg(F.count("*").alias("keys"), F.sum("cnt").alias("mass"))


# Generation

@register("generate_uniform", """SELECT 'key_' || i AS key, CAST(10007 // 300 + CASE WHEN i <= 10007 % 300 THEN 1 ELSE 0 END AS BIGINT) AS cnt FROM range(1, 301) t(i)""")
def generate_uniform(spark, d):
    return generate.uniform(spark, 10_007, 300)


@register("generate_zipf", """WITH r AS (SELECT i, pow(CAST(i AS DOUBLE), -1.05) AS w FROM range(1, 301) t(i)), f AS (SELECT i, CAST(floor(w / (SELECT sum(w ORDER BY i) FROM r) * 100000) AS BIGINT) AS low FROM r),
s AS (SELECT 100000 - CAST(sum(low) AS BIGINT) AS rest FROM f) SELECT 'key_' || i AS key, CAST(low + rest // 300 + CASE WHEN i <= rest % 300 THEN 1 ELSE 0 END AS BIGINT) AS cnt FROM f, s""")
def generate_zipf(spark, d):
    return generate.zipf(spark, 100_000, 300, 1.05)


REMAINDER = """f AS (SELECT *, floor(share) AS low, share - floor(share) AS part FROM shares), d AS (SELECT *, row_number() OVER (ORDER BY part DESC, i DESC) AS r, (SELECT any_value(total) - sum(low) FROM f) AS "left" FROM f)"""


@register("generate_normal", """WITH r AS (SELECT i, exp(-0.5 * pow((i - 25.0) / (0.031 * 500), 2)) AS w FROM range(0, 500) t(i)), f AS (SELECT i, CAST(floor(w / (SELECT sum(w ORDER BY i) FROM r) * 100000) AS BIGINT) AS low FROM r),
s AS (SELECT 100000 - CAST(sum(low) AS BIGINT) AS rest FROM f) SELECT 'key_' || (i + 1) AS key, CAST(low + rest // 500 + CASE WHEN i < rest % 500 THEN 1 ELSE 0 END AS BIGINT) AS cnt FROM f, s WHERE low + rest // 500 + CASE WHEN i < rest % 500 THEN 1 ELSE 0 END > 0""")
def generate_normal(spark, d):
    return generate.normal(spark, 100_000, 500, 50)


@register("generate_heavy_background", """WITH t AS (SELECT i, CAST(greatest(2001, floor((2.0 + (1.05 - 2.0) / 9 * i) * 2001)) AS BIGINT) AS cnt FROM range(0, 10) x(i)), o AS (SELECT 100000 - CAST(sum(cnt) AS BIGINT) AS rest FROM t)
SELECT 'key_' || (i + 1) AS key, cnt FROM t UNION ALL SELECT 'key_' || (i + 11), rest // 490 + CASE WHEN i >= 490 - rest % 490 THEN 1 ELSE 0 END FROM range(0, 490) x(i), o""")
def generate_heavy_background(spark, d):
    return generate.heavy_and_background(spark, 100_000, 500, 50, 10)


@register("generate_flattened", f"""WITH top AS (SELECT CAST(floor(9999.0 + (2001.0 - 9999.0) / 9 * i) AS BIGINT) AS cnt FROM range(0, 10) x(i)), o AS (SELECT 100000 - CAST(sum(cnt) AS BIGINT) AS total FROM top), n AS (SELECT total, CAST(ceil(2 * total / 2001) AS BIGINT) AS k FROM o),
w AS (SELECT total, i, 2000.0::DOUBLE + (1.0::DOUBLE - 2000.0) / (k - 1) * i AS w FROM n, (SELECT unnest(range(0, (SELECT k FROM n))) AS i)), shares AS (SELECT total, i, w / (SELECT sum(w ORDER BY i) FROM w) * total AS share FROM w), {REMAINDER},
a AS (SELECT cnt FROM top UNION ALL SELECT CAST(low + CASE WHEN r <= "left" THEN 1 ELSE 0 END AS BIGINT) FROM d) SELECT cnt, count(*) AS keys FROM a WHERE cnt > 0 GROUP BY ALL""")
def generate_flattened(spark, d):
    """How many keys have each count: which keys these are goes by a seeded shuffle."""
    return generate.flattened(spark, 100_000, 50, 10).groupBy("cnt").agg(F.count("*").alias("keys"))


@register("generate_head_halo")
def generate_head_halo(spark, d):
    """Mass of each window, and its keys over the thresholds of three n at once."""
    rows = generate.head_halo(60_000, 15_000).frame(spark, 8)
    return rows.groupBy("window").agg(F.sum("cnt").alias("mass"), *[F.count_if(F.col("cnt") * n > 60_000).alias(f"heavy_{n}") for n in (100, 200, 400)])


@register("scenario_blend", f"""WITH {EVC}, x AS (SELECT "window", key, cnt AS x FROM c), y AS (SELECT "window" - 1 AS "window", key, cnt AS y FROM c),
j AS (SELECT "window", key, 0.75 * coalesce(x, 0) + 0.25 * coalesce(y, 0) AS mixed FROM x FULL JOIN y USING ("window", key))
SELECT "window", key, CAST(floor(mixed) AS BIGINT) AS cnt FROM j WHERE floor(mixed) > 0 AND "window" IN (SELECT "window" FROM c) AND "window" < (SELECT max("window") FROM c)""")
def scenario_blend(spark, d):
    """Each window blended with the next one."""
    counts = exact.global_counts(tables.events(spark, d))
    after = counts.withColumn("window", F.col("window") - 1)
    both = generate.blend(counts, after, 0.25, ("window",))
    last = counts.agg(F.max("window")).first()[0]
    return both.join(F.broadcast(counts.select("window").distinct()), "window", "left_semi").filter(F.col("window") < last) if last is not None else both


@register("identity_matching", f"""WITH {EVC}, r AS (SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY cnt DESC, key) AS r FROM c)
SELECT b."window", coalesce(a.key, 'new_' || b.key) AS key, b.cnt FROM r b LEFT JOIN r a ON a."window" + 1 = b."window" AND a.r = b.r""")
def identity_matching(spark, d):
    """Each window's keys renamed to those of equal rank in the window before."""
    counts = exact.global_counts(tables.events(spark, d))
    return generate.match_ranks(counts.withColumn("window", F.col("window") + 1), counts, ("window",))


@register("evolved_counts", f"""WITH {EVC} SELECT "window", cnt, count(*) AS keys FROM c GROUP BY ALL""")
def evolved_counts(spark, d):
    """How many keys have each count after an evolution that moves keys into and out of the top: counts as a whole stay."""
    out = generate.evolve(exact.global_counts(tables.events(spark, d)), generate.Evolution(n=60, birth=0.05, newborn=1e9, churn=0.2, top=20))
    return out.groupBy("window", "cnt").agg(F.count("*").alias("keys"))


@register("gutted_hot_keys", f"""WITH {LIC}, m AS (SELECT *, CAST(sum(cnt) OVER (PARTITION BY "window") AS BIGINT) AS mass FROM c),
h AS (SELECT "window", key, cnt, row_number() OVER (PARTITION BY "window" ORDER BY md5('5|' || key)) AS i, count(*) OVER (PARTITION BY "window") AS k FROM m WHERE cnt * 90 > mass),
p AS (SELECT * FROM h WHERE i <= round(k * 0.5))
SELECT c."window", c.key, CAST(CASE WHEN p.i IS NULL THEN c.cnt ELSE 1 END AS BIGINT) AS cnt FROM c LEFT JOIN p ON p."window" = c."window" AND p.key = c.key UNION ALL SELECT "window", 'minted_' || i, cnt - 1 FROM p WHERE cnt > 1""")
def gutted_hot_keys(spark, d):
    return generate.gut_hot_keys(exact.global_counts(tables.lineitem(spark, d)), 90, 0.5, seed=5)


# Adaptive runs

@register("adaptive_space_saving")
def adaptive_space_saving(spark, d):
    return methods.run_adaptive(tables.events(spark, d), methods.parse_methods("ss[epsilon-m=0.15]")[0], 60)


@register("adaptive_hybrid")
def adaptive_hybrid(spark, d):
    return methods.run_adaptive(tables.events(spark, d), methods.parse_methods("hybrid[hyb-head=topn-frontier]")[0], 30)


@register("adaptive_widths")
def adaptive_widths(spark, d):
    return methods.run_adaptive(tables.events(spark, d), methods.parse_methods("hl[hl-adaptive=on]")[0], 60)


@register("method_benchmark")
def method_benchmark(spark, d):
    return methods.benchmark(tables.lineitem(spark, d), "oracle,ss[policy=static q=2n],hl[hl-cert=on],chk", 60, memory=16_384)


# Summaries of runs, over rows made from counts in place of measurements

RUN_SQL = LI + """, k AS (SELECT "window" - (SELECT min("window") FROM li) AS "window", 'm' || (part % 2) AS method, count(*) AS c FROM li GROUP BY ALL),
run AS (SELECT "window", method, c AS heavy, (c - c % 7) / c AS recall, (c - c % 7) / (c - c % 7 + c % 5 + 1) AS precision, (c % 10) / 10 AS f1, CAST(c % 11 AS DOUBLE) AS aae, (c % 13) / 100 AS "are", 50 + c % 17 AS q, c * 10 AS mass,
 c % 9 = 0 AS violation, c % 3 = 0 AS probe_issued, c % 6 = 0 AS probe_failed, c * 0.5::DOUBLE AS kib, 'd' AS dataset, 100 AS n, 'topn' AS head_policy, (c % 13) / 100 AS error, 0.05::DOUBLE AS epsilon FROM k)"""


def run_rows(spark: SparkSession, d: str) -> DataFrame:
    li = tables.lineitem(spark, d)
    first = li.agg(F.min("window")).first()[0]
    k = li.groupBy((F.col("window") - first).alias("window"), F.concat(F.lit("m"), (F.col("part") % 2).cast("string")).alias("method")).agg(F.count("*").alias("c"))
    c = F.col("c")
    tp = c - c % 7
    return k.select(
        "window", "method", c.alias("heavy"), (tp / c).alias("recall"), (tp / (tp + c % 5 + 1)).alias("precision"), ((c % 10) / 10).alias("f1"), (c % 11).cast("double").alias("aae"), ((c % 13) / 100).alias("are"), (50 + c % 17).alias("q"), (c * 10).alias("mass"),
        (c % 9 == 0).alias("violation"), (c % 3 == 0).alias("probe_issued"), (c % 6 == 0).alias("probe_failed"), (c * 0.5).alias("kib"), F.lit("d").alias("dataset"), F.lit(100).alias("n"), F.lit("topn").alias("head_policy"), ((c % 13) / 100).alias("error"), F.lit(0.05).alias("epsilon"),
    )


def phases(spark: SparkSession) -> DataFrame:
    return metrics.timeline(spark.createDataFrame([(1, "easy", 40), (2, "hard", 60)], "step int, phase string, duration int"))


@register("phase_summary", f"""WITH {RUN_SQL}, p AS (SELECT *, CASE WHEN "window" < 40 THEN 'easy' ELSE 'hard' END AS phase FROM run WHERE "window" < 100)
SELECT method, phase, round(avg(100 * aae / mass), 6) AS normalized_error, round(avg(q / 100), 6) AS q_over_n, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, round(avg(CAST(violation AS DOUBLE)), 6) AS violations, count(*) AS windows FROM p GROUP BY ALL""")
def phase_summary(spark, d):
    return rounded(metrics.phase_summary(run_rows(spark, d), phases(spark), 100), "normalized_error", "q_over_n", "recall", "f1", "violations")


@register("controller_summary", f"""WITH {RUN_SQL} SELECT method, round(avg(f1), 6) AS f1, round(avg(recall), 6) AS recall, round(avg(aae), 6) AS aae, round(avg(q), 6) AS q_mean, round(stddev_samp(q), 6) AS q_volatility, round(avg(CAST(violation AS DOUBLE)), 6) AS violations,
CAST(sum(CAST(probe_issued AS BIGINT)) AS BIGINT) AS probes, CAST(sum(CAST(probe_failed AS BIGINT)) AS BIGINT) AS failed_probes FROM run GROUP BY ALL""")
def controller_summary(spark, d):
    return rounded(metrics.controller_summary(run_rows(spark, d)), "f1", "recall", "aae", "q_mean", "q_volatility", "violations")


@register("run_acceptance", f"""WITH {RUN_SQL}, s AS (SELECT method, avg(recall) AS recall, avg(q) AS q_mean FROM run GROUP BY ALL) SELECT min(recall) > 0.5 AS recall_holds, max(q_mean) < 70 AS capacity_holds, min(recall) > 0.5 AND max(q_mean) < 70 AS accepted FROM s""")
def run_acceptance(spark, d):
    return metrics.acceptance(metrics.controller_summary(run_rows(spark, d)), {"recall_holds": "min(recall) > 0.5", "capacity_holds": "max(q_mean) < 70"})


@register("quality_summary", f"""WITH {RUN_SQL}, r AS (SELECT *, round(recall * heavy) AS tp FROM run WHERE "window" > 0), s AS (SELECT method, sum(tp) AS tp, sum(CASE WHEN precision > 0 THEN round(tp / precision) ELSE 0 END) AS said, sum(heavy) AS heavy, sum("are" * heavy) AS rel, avg(kib) AS a, min(kib) AS b, max(kib) AS c FROM r GROUP BY ALL)
SELECT method, round(CASE WHEN said > 0 THEN tp / said ELSE 1.0 END, 6) AS precision, round(tp / heavy, 6) AS recall, round(rel / heavy, 6) AS "are", round(a, 6) AS kib_mean, b AS kib_min, c AS kib_max FROM s""")
def quality_summary(spark, d):
    return rounded(metrics.quality_summary(run_rows(spark, d)), "precision", "recall", "are", "kib_mean")


@register("epsilon_summary", f"""WITH {RUN_SQL} SELECT method, epsilon, round(avg(error), 6) AS error_mean, round(quantile_disc(error, 0.95), 6) AS error_p95, round(avg(CAST(error > epsilon AS DOUBLE)), 6) AS over_epsilon FROM run WHERE "window" > 0 GROUP BY ALL""")
def epsilon_summary(spark, d):
    return rounded(metrics.epsilon_summary(run_rows(spark, d)), "error_mean", "error_p95", "over_epsilon")


@register("ablation_summary", f"""WITH {RUN_SQL} SELECT dataset, CAST(n AS INTEGER) AS n, head_policy, method, round(avg(f1), 6) AS f1, round(avg(recall), 6) AS recall, round(avg(aae), 6) AS aae, round(avg("are"), 6) AS "are", round(avg(kib), 6) AS kib, count(*) AS windows FROM run GROUP BY ALL""")
def ablation_summary(spark, d):
    return rounded(metrics.ablation_summary(run_rows(spark, d)), "f1", "recall", "aae", "are", "kib")


@register("delta_summary", f"""WITH {RUN_SQL} SELECT CAST(q % 4 AS BIGINT) AS m, round(avg(CAST(violation AS DOUBLE)), 6) AS delta_selected, round(1 - sum(heavy) / sum(mass), 6) AS traffic_saved, round(sum(mass) / sum(q), 6) AS apply_speed_up FROM run GROUP BY ALL""")
def delta_summary(spark, d):
    rows = run_rows(spark, d).select((F.col("q") % 4).alias("m"), F.col("violation").alias("selected"), F.col("heavy").alias("bytes"), F.col("mass").alias("full_bytes"), F.col("mass").alias("full_ms"), F.col("q").alias("ms"))
    return rounded(metrics.delta_summary(rows), "delta_selected", "traffic_saved", "apply_speed_up")


@register("run_validation", f"""WITH {RUN_SQL}, w AS (SELECT "window", count(DISTINCT method) AS m, sum(CASE WHEN f1 < 0 OR f1 > 1 THEN 1 ELSE 0 END) AS o FROM run GROUP BY ALL) SELECT count(*) AS windows, count(*) FILTER (WHERE m <> 2) AS bad_windows, CAST(sum(o) AS BIGINT) AS outside, count(*) = 83 AND count(*) FILTER (WHERE m <> 2) = 0 AND sum(o) = 0 AS valid FROM w""")
def run_validation(spark, d):
    return metrics.validate_run(run_rows(spark, d), 83, ["m0", "m1"], ["f1", "recall"])


@register("reduced_by_ranges", SS + f""", {certify_sql(20)} SELECT "window", id, est, reporters, cert_lb, cert_ub, inflation, hidden FROM cert""")
def reduced_by_ranges(spark, d):
    """The reduction that merges ranges of ids in order."""
    parts, reports = reduce.from_sketch(sketches.space_saving(tables.events(spark, d), 10))
    return reduce.certify(parts, reports, 20, prune=False, reducer="parallel-streaming").select("window", "id", "est", "reporters", "cert_lb", "cert_ub", "inflation", "hidden")


@register("reducers_agree", SS + f""", {certify_sql(20)} SELECT "window", count(*) AS ids, CAST(sum(est) AS BIGINT) AS mass FROM cert GROUP BY ALL""")
def reducers_agree(spark, d):
    """Ids, and the sum of their estimates, on which the reducers agree, from summaries that are far from exact."""
    parts, reports = reduce.from_sketch(sketches.space_saving(tables.events(spark, d), 10))
    a, b, c = (reduce.certify(parts, reports, 20, prune=False, reducer=r) for r in ("hash", "streaming", "parallel-streaming"))
    columns = ["est", "cert_lb", "cert_ub", "inflation", "hidden"]
    differ = reduce.equivalent(a, b, columns, keys=("window", "id")).select("window", "id").union(reduce.equivalent(a, c, columns, keys=("window", "id")).select("window", "id"))
    return a.join(differ, ["window", "id"], "left_anti").groupBy("window").agg(F.count("*").alias("ids"), F.sum("est").alias("mass"))


@register("coordinator_bytes", SS + f""", {certify_sql(20)}, r AS (SELECT "window", count(*) * 24 AS records, count(DISTINCT key) AS ids FROM rep GROUP BY ALL), h AS (SELECT "window", count(DISTINCT part) * 32 AS headers FROM rep GROUP BY ALL), i AS (SELECT "window", count(*) AS items FROM cert WHERE cert_ub >= threshold GROUP BY ALL)
SELECT "window", headers + records AS ingress, ids * 48 AS aggregate, coalesce(items, 0) * 64 AS result, headers + records + ids * 48 + coalesce(items, 0) * 64 AS peak FROM r JOIN h USING ("window") LEFT JOIN i USING ("window")""")
def coordinator_bytes(spark, d):
    parts, reports = reduce.from_sketch(sketches.space_saving(tables.events(spark, d), 10))
    return reduce.coordinator_bytes(parts, reports, reduce.certify(parts, reports, 20))
