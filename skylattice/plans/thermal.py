"""Queries on weather, comparison of runs, felt temperature and wind."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import stress_category, thermal_stress
from ..operators import compare, focal, gates, gridding, kernels, weather, wind, zonal
from .stand_ins import BUILDINGS, CELL_M, CELLS, CHANGES, COLS, GRID, HALVES, LAT, LON, PTS, TILES, WEATHER, buildings, cells, changes, halves, points, read, sql, sun_table, tiles
from .stand_ins import weather as weather_rows

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
HA = CELL_M * CELL_M / 10_000


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return keep


def _days(spark, sf):
    return weather_rows(spark, sf).select("day", "unix_s").distinct()


_MINUTES = sun_table("(SELECT day, unix_s, m::INT AS minute FROM (SELECT DISTINCT day, unix_s FROM weather), generate_series(0, 288) g(k), (SELECT 5 AS f) f, LATERAL (SELECT k * f AS m))", "unix_s + minute * 60 + 18000.0")


@query(sql(f"SELECT day::VARCHAR AS day, min(minute) FILTER (b < -0.833 AND altitude >= -0.833) AS sunrise, max(minute) FILTER (b >= -0.833 AND altitude < -0.833) AS sunset FROM (SELECT *, lag(altitude) OVER (PARTITION BY day ORDER BY minute) AS b FROM {_MINUTES}) GROUP BY ALL", PTS, WEATHER))
def sunrise_sunset_crossings(spark, sf):
    return weather.crossings(_days(spark, sf), LAT, LON, minutes=5).withColumn("day", F.col("day").cast("string"))


_SUNNY = sun_table("(SELECT * FROM weather)", "unix_s + (hour - 0.5) * 3600 + 18000.0")
_CLEAR = f"clear AS (SELECT *, CASE WHEN sin(radians(altitude)) > 0 THEN 1098 * sin(radians(altitude)) * exp(-0.057 / sin(radians(altitude))) ELSE 0 END AS cs FROM {_SUNNY})"


@query(sql("SELECT day::VARCHAR AS day, ratio, row_number() OVER (ORDER BY ratio DESC, day)::INT AS rank, round(m, 6) AS measured, round(c, 6) AS clear FROM (SELECT day, sum(coalesce(ghi, 0)) AS m, sum(cs) AS c, round_even(sum(coalesce(ghi, 0)) / sum(cs), 4) AS ratio FROM clear WHERE cs > 0 GROUP BY day)", PTS, WEATHER, _CLEAR))
def clearest_day(spark, sf):
    """All days by their clearness."""
    return weather.clearest_day(weather_rows(spark, sf), LAT, LON).select(F.col("day").cast("string").alias("day"), "ratio", "rank", F.round("measured", 6).alias("measured"), F.round("clear", 6).alias("clear"))


@query(sql("""SELECT target::VARCHAR AS target, day::VARCHAR AS day, place AS "offset", ratio, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY ratio DESC, place) AS rank FROM (
  SELECT t.day AS target, d.day, (d.day - t.day)::INT AS place, d.ratio FROM (SELECT DISTINCT day FROM weather WHERE dayofyear(day) % 9 = 0) t JOIN ratios d ON abs(d.day - t.day) <= 12)) WHERE rank <= 6""",
  PTS, WEATHER, _CLEAR, "ratios AS (SELECT day, round_even(sum(coalesce(ghi, 0)) / sum(cs), 4) AS ratio FROM clear WHERE cs > 0 GROUP BY day)"))
def chosen_days(spark, sf):
    """The six clearest of the 25 days around every ninth day of the year; rank 1 is the chosen one."""
    w = weather_rows(spark, sf)
    targets = w.select(F.col("day").alias("target")).where("dayofyear(target) % 9 = 0").distinct()
    out = weather.chosen_days(w, targets, LAT, LON)
    return out.select(F.col("target").cast("string").alias("target"), F.col("day").cast("string").alias("day"), "offset", "ratio", "rank")


@query(
    sql(
        """SELECT s.day::VARCHAR AS day, s.ts, w.hour AS hour, round(w.ghi, 4) AS ghi, greatest(round(w.ws, 4), 0.5::DOUBLE) AS ws FROM (
  SELECT day, ((day - 1)::TIMESTAMP + INTERVAL 1 HOUR * k) AS ts FROM (SELECT DISTINCT day FROM weather), generate_series(0, 47) g(k)) s
  JOIN weather w ON w.day = (CASE WHEN hour(ts) = 0 THEN ts::DATE - 1 ELSE ts::DATE END) AND w.hour = CASE WHEN hour(ts) = 0 THEN 24 ELSE hour(ts) END""",
        PTS, WEATHER,
    )
)
def hour_ending_lookup(spark, sf):
    w = weather_rows(spark, sf)
    series = weather.spin_up(w.select("day").distinct()).select("day", "ts")
    by = w.select(F.month("day").alias("month"), F.dayofmonth("day").alias("day"), "hour", "ghi", "ws")
    keyed = series.select(F.col("day").alias("asked"), "ts", *weather.hour_ending_key(F.col("ts")))
    return keyed.join(by, ["month", "day", "hour"]).select(F.col("asked").cast("string").alias("day"), "ts", "hour", F.round("ghi", 4).alias("ghi"), F.greatest(F.round("ws", 4), F.lit(0.5)).alias("ws"))


@query(sql(f"SELECT zone, count(*) AS cells, round(avg((before < 0.25)::INT), 6) AS never_before, round(avg((after < 0.25)::INT), 6) AS never_after, count(*) FILTER (after < 0.25 AND before >= 0.25) AS newly_dark, round(count(*) FILTER (before - after >= 1) * {HA}::DOUBLE, 6) AS lost_ha, round(avg(after - before), 6) AS mean_change FROM pairs GROUP BY zone", PTS, HALVES))
def before_after_change(spark, sf):
    one, two = halves(spark, sf)
    out = compare.before_after(compare.paired(one, two, "v", ["row", "col", "zone"]), "zone", HA)
    return out.select("zone", "cells", F.round("never_before", 6).alias("never_before"), F.round("never_after", 6).alias("never_after"), "newly_dark", F.round("lost_ha", 6).alias("lost_ha"), F.round("mean_change", 6).alias("mean_change"))


@query(sql('SELECT zone, count(*) FILTER (w <= -2) AS any_2, sum(h2)::BIGINT AS hours_2, count(*) FILTER (w <= -5) AS any_5, sum(h5)::BIGINT AS hours_5, count(*) FILTER (w <= -10) AS any_10, sum(h10)::BIGINT AS hours_10 FROM (SELECT zone, "row", col, min(du) AS w, count(*) FILTER (du <= -2) AS h2, count(*) FILTER (du <= -5) AS h5, count(*) FILTER (du <= -10) AS h10 FROM changes GROUP BY ALL) GROUP BY zone', PTS, CHANGES))
def any_hour_area(spark, sf):
    return compare.any_hour(changes(spark, sf), (-2, -5, -10), "zone")


@query(sql("SELECT zone, hour, most FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY most DESC, hour) AS k FROM (SELECT zone, hour, count(*) FILTER (du <= -5) AS most FROM changes GROUP BY ALL)) WHERE k = 1", PTS, CHANGES))
def worst_hour(spark, sf):
    return compare.worst_hour(changes(spark, sf), -5.0, "zone")


@query(sql(f"SELECT zone, {', '.join(f'round(quantile_cont(du, {p / 100}), 6) AS p{p:02d}' for p in (1, 5, 50, 95, 99))}, count(*) AS moved FROM changes WHERE abs(du) >= 0.1 GROUP BY zone", PTS, CHANGES))
def moved_percentiles(spark, sf):
    out = compare.moved_percentiles(changes(spark, sf), "zone")
    return out.select("zone", *[F.round(c, 6).alias(c) for c in ("p01", "p05", "p50", "p95", "p99")], "moved")


_CAT = " + ".join("({v} >= " + f"{e})::INT" for e in (-40, -27, -13, 0, 9, 26, 32, 38, 46))


@query(sql(f"SELECT a AS before, b AS after, count(*) AS cells, round(avg(greatest(9 - felt, felt - 26, 0)), 6) AS stress FROM (SELECT *, {_CAT.format(v='felt')} AS a, {_CAT.format(v='(felt + du)')} AS b FROM changes) GROUP BY a, b", PTS, CHANGES))
def stress_category_moves(spark, sf):
    c = changes(spark, sf).withColumn("before", stress_category(F.col("felt"))).withColumn("after", stress_category(F.col("felt") + F.col("du")))
    return c.groupBy("before", "after").agg(F.count("*").alias("cells"), F.round(F.avg(thermal_stress(F.col("felt"))), 6).alias("stress"))


@query(sql('SELECT "row" // 5 AS srow, col // 5 AS scol, count(*) AS n, round(avg(heights::DOUBLE), 5) AS mean FROM cells GROUP BY ALL HAVING count(*) >= 12', PTS, GRID, CELLS))
def section_means_columns(spark, sf):
    return zonal.section_means(cells(spark, sf), "heights").withColumn("mean", F.round("mean", 5))


@query(
    sql(
        """SELECT day::VARCHAR AS day, hour, run, away FROM (SELECT w.day, w.hour, n.n_nationkey AS run, d.away, row_number() OVER (PARTITION BY w.day, w.hour ORDER BY d.away, n.n_nationkey) AS k
  FROM weather w, nation n, LATERAL (SELECT n.n_nationkey * 22.5::DOUBLE - 360 * floor(n.n_nationkey * 22.5::DOUBLE / 360) AS dir), LATERAL (SELECT abs((w.wd - dir + 180) - 360 * floor((w.wd - dir + 180) / 360) - 180) AS away) d) WHERE k = 1""",
        PTS, WEATHER,
    )
)
def nearest_direction(spark, sf):
    runs = read(spark, sf, "nation").select(F.col("n_nationkey").alias("run"), F.pmod(F.col("n_nationkey") * F.lit(22.5), F.lit(360.0)).alias("run_direction"))
    # The catalog's circular distance is symmetric, so the side of the difference does not matter.
    hours = weather_rows(spark, sf).select("day", "hour", F.col("wd").alias("direction"))
    return wind.nearest_run(hours, runs).select(F.col("day").cast("string").alias("day"), "hour", "run", "away")


_PLACES = """places AS (SELECT vec_id AS id, label, ((vec_id * 37) % 64) / 10.0::DOUBLE AS fr, ((vec_id * 53) % 71) / 10.0::DOUBLE AS fc FROM embeddings)"""


@query(
    sql(
        """, got AS (SELECT p.id, sum(w * v) AS num, sum(w) AS den FROM places p, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(a, b), tiles t,
  LATERAL (SELECT (CASE WHEN a = 1 THEN fr - floor(fr) ELSE 1 - (fr - floor(fr)) END) * (CASE WHEN b = 1 THEN fc - floor(fc) ELSE 1 - (fc - floor(fc)) END) AS w) x
  WHERE t.vec_id = p.id AND t."row" = floor(fr)::INT + a AND t.col = floor(fc)::INT + b AND t.v > 0 GROUP BY p.id)
 SELECT p.id, round(CASE WHEN den > 0.25 THEN num / den END, 6) AS value FROM places p LEFT JOIN got g ON g.id = p.id""",
        TILES, _PLACES,
    ).replace(" , got AS", ", got AS")
)
def bilinear_gather(spark, sf):
    t = tiles(spark, sf).where("v > 0")
    # Tiles lie side by side, ten rows apart, so that a point reaches its own tile only.
    wide = t.select((F.col("row") + F.col("vec_id") * 10).cast("int").alias("row"), "col", "v")
    p = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), ((F.col("vec_id") * 37 % 64) / 10.0 + F.col("vec_id") * 10).alias("fr"), ((F.col("vec_id") * 53 % 71) / 10.0).alias("fc"))
    return focal.bilinear(p, wide, "v").select("id", F.round("value", 6).alias("value"))


@query(sql('SELECT count(*) AS n, round(median(v::DOUBLE), 6) AS reference FROM (SELECT CASE WHEN NOT nodata THEN surface END AS v, row_number() OVER (ORDER BY "row", col) - 1 AS k FROM cells WHERE park) WHERE k % 3 = 0', PTS, GRID, CELLS))
def lawn_reference(spark, sf):
    c = cells(spark, sf).select("row", "col", F.col("park").alias("lawn"), F.when(~F.col("nodata"), F.col("surface").cast("double")).alias("v"))
    return wind.street_reference(c, "v").select("n", F.round("reference", 6).alias("reference"))


@query(sql('SELECT p."row", p.col, round(greatest(-99::DOUBLE, least(100 * (after / greatest(before, 0.02) - 1), 399::DOUBLE)), 5) AS percent, round(CASE WHEN abs(after - before) > 0.3 * noise THEN after - before ELSE 0 END, 6) AS kept FROM pairs p JOIN (SELECT zone, stddev_pop(after - before) AS noise FROM pairs WHERE "row" % 4 > 0 GROUP BY zone) n ON p.zone = n.zone', PTS, HALVES))
def noise_bar_reconcile(spark, sf):
    one, two = halves(spark, sf)
    p = compare.paired(one, two, "v", ["row", "col", "zone"]).withColumn("change", F.col("after") - F.col("before"))
    noise = wind.noise_bar(p, F.col("row") % 4 > 0, "zone")
    out = wind.with_percent(wind.reconciled(p, noise, "zone", sigmas=0.3))
    return out.select("row", "col", F.round("percent", 5).alias("percent"), F.round("kept", 6).alias("kept"))


@query(sql("SELECT zone, count(*) AS n, round(corr(before, after), 6) AS r, round(avg(abs(before - after)), 6) AS mae, round(avg(before - after), 6) AS bias, round(sqrt(avg((before - after) * (before - after))), 6) AS rmse, round(avg((abs(before - after) <= 0.25 * abs(after))::INT), 6) AS hit_rate, round(avg(before) / avg(after), 6) AS mean_ratio, round(avg(abs(before - after)) FILTER (\"row\" < 50), 6) AS near_mae, count(*) FILTER (\"row\" < 50) AS near_n, round(avg(abs(before / nullif(after, 0) - 1)) FILTER (\"row\" < 50), 6) AS near_relative, round(avg(before / nullif(after, 0) - 1), 6) AS relative_bias FROM pairs GROUP BY zone", PTS, HALVES))
def benchmark_metrics(spark, sf):
    one, two = halves(spark, sf)
    p = compare.paired(one, two, "v", ["row", "col", "zone"]).withColumnsRenamed({"before": "model", "after": "measured"})
    out = wind.benchmark_scores(p, "zone", near=F.col("row") < 50)
    return out.select("zone", "n", "near_n", *[F.round(c, 6).alias(c) for c in ("r", "mae", "bias", "rmse", "hit_rate", "mean_ratio", "near_mae", "near_relative", "relative_bias")])


@query(sql('SELECT round(median(abs(a - b)) / median(m), 6) AS median_change, round(quantile_cont(abs(a - b), 0.9), 6) AS p90_change FROM (SELECT "row", col, avg(z) FILTER (half = 1) AS a, avg(z) FILTER (half = 2) AS b, avg(z) AS m FROM (SELECT *, CASE WHEN hours < 360 THEN 1 ELSE 2 END AS half FROM (SELECT "row", floor(hours - 24 * floor(hours / 24))::INT AS col, z, hours FROM pts)) GROUP BY "row", col) WHERE a IS NOT NULL AND b IS NOT NULL', PTS))
def convergence_halves(spark, sf):
    p = points(spark, sf).select("row", F.floor(F.pmod("hours", F.lit(24.0))).cast("int").alias("col"), F.when(F.col("hours") < 360, 1).otherwise(2).alias("half"), F.col("z").alias("speed"))
    return wind.convergence(p).select(F.round("median_change", 6).alias("median_change"), F.round("p90_change", 6).alias("p90_change"))


@query(
    sql(
        """, t AS (SELECT label, max(heights)::DOUBLE AS top, median(heights::DOUBLE) AS overall, count(*) AS n FROM cells WHERE label > 0 GROUP BY label),
  lv AS (SELECT label, top - 0.5 * k AS h, n FROM t, generate_series(0, 2000) g(k) WHERE top - 0.5 * k > 0),
  ok AS (SELECT lv.label, max(lv.h) AS h FROM lv JOIN LATERAL (SELECT count(*) AS c FROM cells c WHERE c.label = lv.label AND c.heights >= lv.h - 5 AND c.heights <= lv.h + 5) x ON x.c >= 0.1 * lv.n GROUP BY lv.label)
  SELECT t.label, round(coalesce(m.m, overall), 4) AS roof_level FROM t LEFT JOIN (SELECT ok.label, median(c.heights::DOUBLE) AS m FROM ok JOIN cells c ON c.label = ok.label AND c.heights >= ok.h - 5 AND c.heights <= ok.h + 5 GROUP BY ok.label) m ON m.label = t.label""",
        PTS, GRID, CELLS,
    ).replace(" , t AS", ", t AS")
)
def roof_level(spark, sf):
    c = cells(spark, sf).where("label > 0").withColumn("heights", F.col("heights").cast("double"))
    return zonal.roof_levels(c, "label", "heights").withColumn("roof_level", F.round("roof_level", 4))


@query(sql("SELECT scope, key, round_even(value, 4) AS value, CASE WHEN key IN ('moved') OR NOT (SELECT coalesce(count(DISTINCT label) >= 3, false) FROM embeddings) THEN 'internal' ELSE 'publishable' END AS status FROM (UNPIVOT (SELECT zone::VARCHAR AS scope, count(*)::DOUBLE AS moved, avg(du) AS mean_change, min(du) AS worst FROM changes GROUP BY zone) ON moved, mean_change, worst INTO NAME key VALUE value)", PTS, CHANGES))
def numbers_long_table(spark, sf):
    c = changes(spark, sf).groupBy("zone").agg(F.count("*").cast("double").alias("moved"), F.avg("du").alias("mean_change"), F.min("du").alias("worst"))
    passed = read(spark, sf, "embeddings").agg(F.coalesce(F.count_distinct("label") >= 3, F.lit(False)).alias("validated"))
    numbers = compare.numbers_table(c, "zone", ["moved", "mean_change", "worst"], ["moved"], F.lit(True)).join(F.broadcast(passed))  # one row
    return numbers.withColumn("status", F.when(F.col("validated"), F.col("status")).otherwise("internal")).drop("validated")


@query(sql("""SELECT name, n = 0 AS pass, n AS failures FROM (SELECT unnest(['ground_below', 'counts', 'roof_known']) AS name, unnest([count(*) FILTER (NOT coalesce(ground <= surface, false)), count(*) FILTER (NOT coalesce(singles <= returns, false)), count(*) FILTER (NOT coalesce(roof <= surface, false))]) AS n FROM cells)""", PTS, GRID, CELLS))
def input_invariants(spark, sf):
    checks = {"ground_below": F.col("ground") <= F.col("surface"), "counts": F.col("singles") <= F.col("returns"), "roof_known": F.col("roof") <= F.col("surface")}
    return gates.invariants(cells(spark, sf), checks)


@query(sql("SELECT name, pass, \"when\" FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY \"when\" DESC, later DESC, fresh DESC) AS k FROM (SELECT 'V' || (o_custkey % 7) AS name, o_totalprice > 100000 AS pass, o_orderdate AS \"when\", o_orderkey AS fresh, o_custkey % 7 < 5 AND o_orderkey % 2 = 1 AS later FROM orders WHERE o_orderkey % 2 = 0 OR o_custkey % 7 < 5)) WHERE k = 1"))
def gate_records(spark, sf):
    """Gates of one half of the orders, into which those of the other half are upserted; some names have no new record."""
    o = read(spark, sf, "orders").select(F.concat(F.lit("V"), F.col("o_custkey") % 7).alias("name"), (F.col("o_totalprice") > 100000).alias("pass"), F.col("o_orderdate").alias("when"), "o_orderkey", "o_custkey")
    best = lambda half: half.groupBy("name").agg(F.max_by(F.struct("pass", "when"), F.struct("when", "o_orderkey")).alias("r")).select("name", "r.pass", "r.when")
    fresh = (F.col("o_orderkey") % 2 == 1) & (F.col("o_custkey") % 7 < 5)
    return gates.upserted(best(o.where(F.col("o_orderkey") % 2 == 0)), best(o.where(fresh))).select("name", "pass", "when")


@query(sql('SELECT "row" // 4 AS j, col // 4 AS i, round(avg(ground::DOUBLE), 5) AS ground, round(median(surface::DOUBLE - ground::DOUBLE), 5) AS bh, round(coalesce(avg(singles::DOUBLE) FILTER (singles > 2), 0), 6) AS ch, round(avg((singles > 2)::INT), 6) AS cover, least(40, greatest(0, ceil((avg(ground::DOUBLE) + median(surface::DOUBLE - ground::DOUBLE)) / 12.5 - 0.5)))::INT AS kfirst FROM cells GROUP BY ALL', PTS, GRID, CELLS))
def voxel_columns(spark, sf):
    c = cells(spark, sf).select("row", "col", F.col("ground").cast("double").alias("ground"), (F.col("surface").cast("double") - F.col("ground").cast("double")).alias("building"), F.col("singles").cast("double").alias("canopy"))
    v = wind.voxel_columns(c, 4, 12.5, 40)
    return v.select("j", "i", *[F.round(x, r).alias(x) for x, r in (("ground", 5), ("bh", 5), ("ch", 6), ("cover", 6))], "kfirst")


@query()
def lattice_flow_small(spark, sf):
    c = cells(spark, sf).groupBy(F.floor(F.col("row") / 25).cast("long").alias("run"), F.floor(F.col("col") / 4).cast("int").alias("k")).agg(F.floor(F.avg("heights") / 60).cast("int").alias("height"))
    return kernels.flow_runs(c)


@query(sql("SELECT * FROM grid", PTS, GRID))
def gridding_stream(spark, sf):
    import uuid

    from ..sources.scratch import scratch
    from ..streaming.gridding import grid_stream

    folder = scratch(spark, f"stream-{uuid.uuid4().hex}")
    points(spark, sf).drop("hours").repartition(4).write.parquet(f"{folder}/points")
    schema = spark.read.parquet(f"{folder}/points").schema
    return grid_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/points"), folder)
