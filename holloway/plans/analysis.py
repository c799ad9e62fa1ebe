"""Profiles, decisions, statistics and records: queries over the other tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classes, records
from ..lineage import numbered
from ..operators import decision, graph, profile, raster
from .tables import CELL, NEAR_SQL, SITES_SQL, SLOPE_SQL, dem, read, sites

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


WALK_SQL = "w AS (SELECT user_id, event_id * 10.0::DOUBLE AS d, value AS z FROM events)"
STEP_SQL = WALK_SQL + ", s AS (SELECT *, d - lag(d) OVER o AS step, z - lag(z) OVER o AS climb FROM w WINDOW o AS (PARTITION BY user_id ORDER BY d)), k AS (SELECT *, 100 * climb / step AS slope FROM s)"


def walk(spark, sf_dir):
    return read(spark, sf_dir, "events").select("user_id", (F.col("event_id") * 10.0).alias("d"), F.col("value").alias("z"))


@query(f"WITH {WALK_SQL} SELECT user_id, d, round(avg(z) OVER (PARTITION BY user_id ORDER BY d ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS smooth FROM w")
def profile_smooth(spark, sf_dir):
    return profile.smoothed(walk(spark, sf_dir), ["user_id"], "d", "z").select("user_id", "d", F.round("smooth", 6).alias("smooth"))


@query(f"WITH {STEP_SQL} SELECT user_id, d, round(slope, 6) AS slope_pct, round(sum(greatest(coalesce(climb, 0), 0)) OVER o, 6) AS ascent, round(sum(greatest(-coalesce(climb, 0), 0)) OVER o, 6) AS descent, CAST(floor(d / 5000) AS BIGINT) AS segment FROM k WINDOW o AS (PARTITION BY user_id ORDER BY d)")
def profile_cumulative(spark, sf_dir):
    t = profile.climbs(walk(spark, sf_dir), ["user_id"], "d", "z")
    return t.select("user_id", "d", *[F.round(k, 6).alias(k) for k in ("slope_pct", "ascent", "descent")], F.floor(F.col("d") / 5000).alias("segment"))


@query(f"WITH {STEP_SQL} SELECT user_id, max(d) - min(d) AS length, min(z) AS low, max(z) AS high, round(sum(greatest(coalesce(climb, 0), 0)), 6) AS ascent, round(sum(greatest(-coalesce(climb, 0), 0)), 6) AS descent, round(avg(abs(slope)), 6) AS mean_slope, round(max(abs(slope)), 6) AS max_slope, round(arg_min(slope, d) FILTER (slope IS NOT NULL), 6) AS first_slope FROM k GROUP BY user_id")
def profile_stats(spark, sf_dir):
    t = profile.profile_stats(walk(spark, sf_dir), ["user_id"], "d", "z")
    return t.select("user_id", "length", "low", "high", *[F.round(k, 6).alias(k) for k in ("ascent", "descent", "mean_slope", "max_slope", "first_slope")])


@query("WITH e AS (SELECT user_id, event_id, event_type IN ('click', 'view') AS inside FROM events), t AS (SELECT *, CASE WHEN inside = lag(inside) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS turn FROM e), r AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM t) SELECT user_id, CAST(run AS BIGINT) AS run, bool_or(inside) AS inside, min(event_id) AS first, max(event_id) AS last FROM r GROUP BY user_id, run")
def profile_islands(spark, sf_dir):
    """Runs of events inside and outside."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").isin("click", "view").alias("inside"))
    return profile.islands(e, ["user_id"], "event_id", F.col("inside")).groupBy("user_id", "run").agg(F.bool_or("inside").alias("inside"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


RANGE_SQL = "g AS (SELECT l_orderkey % 97 AS line, l_partkey * 7 % 5003 AS start, l_partkey * 7 % 5003 + l_quantity / 10 AS stop FROM lineitem)"


@query(f"WITH {RANGE_SQL}, n AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY line ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 0.5 THEN 0 ELSE 1 END AS fresh FROM g), r AS (SELECT *, sum(fresh) OVER (PARTITION BY line ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS run FROM n) SELECT line, min(start) AS start, max(stop) AS stop, count(*) AS parts FROM r GROUP BY line, run")
def merge_ranges(spark, sf_dir):
    g = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 97 AS line", "l_partkey * 7 % 5003 AS start", "l_partkey * 7 % 5003 + l_quantity / 10 AS stop")
    return profile.merged_ranges(g, ["line"])


@query("WITH s AS (SELECT s_suppkey AS id, s_suppkey * 37 % 101 * 1.0::DOUBLE AS x1, s_suppkey * 53 % 97 * 1.0::DOUBLE AS y1, s_suppkey * 11 % 89 * 1.0::DOUBLE AS x2, s_suppkey * 29 % 83 * 1.0::DOUBLE AS y2 FROM supplier), n AS (SELECT *, CAST(greatest(1, ceil(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) / 10)) AS INT) AS n FROM s) SELECT id, CAST(i AS INT) AS i, round(x1 + (x2 - x1) * (i / n), 9) AS x, round(y1 + (y2 - y1) * (i / n), 9) AS y FROM n, range(0, 50) r(i) WHERE i <= n")
def densify(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_suppkey * 37 % 101 * 1.0D AS x1", "s_suppkey * 53 % 97 * 1.0D AS y1", "s_suppkey * 11 % 89 * 1.0D AS x2", "s_suppkey * 29 % 83 * 1.0D AS y2")
    return profile.densified(s, 10.0).select("id", "i", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(MEASURES) for b in MEASURES[i:]))
def correlation_matrix(spark, sf_dir):
    return decision.correlations(read(spark, sf_dir, "lineitem"), MEASURES).select("a", "b", F.round("r", 6).alias("r"))


@query("WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS x, corr(l_quantity, l_discount) AS y, corr(l_extendedprice, l_discount) AS z FROM lineitem), v AS (SELECT 1 + 2*x*y*z - x*x - y*y - z*z AS det, x, y, z FROM c) "
       "SELECT 'l_quantity' AS column, round((1 - z*z) / det, 6) AS vif, CASE WHEN (1 - z*z) / det >= 10 THEN 'bad' WHEN (1 - z*z) / det >= 5 THEN 'warn' ELSE 'ok' END AS level FROM v UNION ALL SELECT 'l_extendedprice', round((1 - y*y) / det, 6), CASE WHEN (1 - y*y) / det >= 10 THEN 'bad' WHEN (1 - y*y) / det >= 5 THEN 'warn' ELSE 'ok' END FROM v UNION ALL SELECT 'l_discount', round((1 - x*x) / det, 6), CASE WHEN (1 - x*x) / det >= 10 THEN 'bad' WHEN (1 - x*x) / det >= 5 THEN 'warn' ELSE 'ok' END FROM v")
def vif_report(spark, sf_dir):
    return decision.inflation(read(spark, sf_dir, "lineitem"), MEASURES[:3]).select("column", F.round("vif", 6).alias("vif"), "level")


#: Each supplier judges three criteria: slope against view, water against slope, view against water.
JUDGED_SQL = "j AS (SELECT s_suppkey AS judge, 0.5 + s_suppkey % 23 AS sv, 0.2 + s_nationkey AS ws, CASE WHEN s_suppkey % 4 <> 0 THEN (1 + s_suppkey % 7) / 3.0::DOUBLE END AS vw FROM supplier), k AS (SELECT judge, greatest(1 / 9.0::DOUBLE, least(9, sv)) AS sv, greatest(1 / 9.0::DOUBLE, least(9, 1 / ws)) AS sw, greatest(1 / 9.0::DOUBLE, least(9, coalesce(vw, 1))) AS vw FROM j)"


def _judged(spark, sf_dir):
    t = read(spark, sf_dir, "supplier")
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.expr(v).cast("double").alias("ratio")) for a, b, v in (("slope", "view", "0.5D + s_suppkey % 23"), ("water", "slope", "0.2D + s_nationkey"), ("view", "water", "CASE WHEN s_suppkey % 4 <> 0 THEN (1 + s_suppkey % 7) / 3.0D END"))])
    return t.select(F.col("s_suppkey").alias("judge"), F.inline(rows)).where("ratio IS NOT NULL")


KEYS = ["slope", "view", "water"]


@query(f"WITH {JUDGED_SQL} SELECT judge, a, b, round(ratio, 9) AS ratio FROM (SELECT judge, 'slope' AS a, 'view' AS b, sv AS ratio FROM k UNION ALL SELECT judge, 'slope', 'water', sw FROM k UNION ALL SELECT judge, 'view', 'water', vw FROM k)")
def pair_sanitize(spark, sf_dir):
    return decision.clean_pairs(_judged(spark, sf_dir), KEYS, "judge").select("judge", "a", "b", F.round("ratio", 9).alias("ratio"))


WEIGHED_SQL = JUDGED_SQL + ", g AS (SELECT judge, pow(sv * sw, 1 / 3.0::DOUBLE) AS s, pow(vw / sv, 1 / 3.0::DOUBLE) AS v, pow(1 / (sw * vw), 1 / 3.0::DOUBLE) AS w, pow(sw / (sv * vw), 1 / 3.0::DOUBLE) AS t FROM k), u AS (SELECT judge, unnest([{'c': 'slope', 'x': s}, {'c': 'view', 'x': v}, {'c': 'water', 'x': w}]) AS p, s + v + w AS total, 1 + t + 1 / t AS top FROM g)"


@query(f"WITH {WEIGHED_SQL} SELECT judge, p.c AS criterion, round(p.x / total, 6) AS weight, round(top, 6) AS lambda_max, round(abs((top - 3) / 2 / 0.58), 6) AS consistency FROM u")
def ahp_weights(spark, sf_dir):
    """Weights of each judge's criteria. Of three criteria the eigenvector is the geometric mean of the rows, which the SQL takes."""
    t = decision.pair_weights(_judged(spark, sf_dir), KEYS, "judge")
    return t.select("judge", "criterion", F.round("weight", 6).alias("weight"), F.round("lambda_max", 6).alias("lambda_max"), F.abs(F.round("consistency", 6)).alias("consistency"))


@query(f"WITH {JUDGED_SQL}, {WEIGHED_SQL.split(', ', 0)[0][len(JUDGED_SQL) + 2:]}, o AS (SELECT judge, sv / (1 + sv) AS terrain, 1 / (1 + sv) AS access FROM k), l AS (SELECT judge, p.c AS criterion, p.x / total AS w FROM u) SELECT judge, criterion, round(w * CASE WHEN criterion = 'water' THEN access ELSE terrain END / sum(w * CASE WHEN criterion = 'water' THEN access ELSE terrain END) OVER (PARTITION BY judge), 6) AS weight FROM l JOIN o USING (judge)")
def ahp_hierarchy(spark, sf_dir):
    """Criteria in two groups: a group's weight times a criterion's."""
    inner = decision.pair_weights(_judged(spark, sf_dir), KEYS, "judge").select("judge", "criterion", "weight", F.when(F.col("criterion") == "water", "access").otherwise("terrain").alias("grp"))
    groups = _judged(spark, sf_dir).where("a = 'slope'").select("judge", F.lit("terrain").alias("a"), F.lit("access").alias("b"), "ratio")
    outer = decision.pair_weights(groups, ["terrain", "access"], "judge").select("judge", F.col("criterion").alias("grp"), "weight")
    return decision.hierarchy_weights(outer, inner, "judge").select("judge", "criterion", F.round("weight", 6).alias("weight"))


@query("SELECT p_type AS code, CAST(dense_rank() OVER (ORDER BY first) AS INT) AS int_value, feature_count FROM (SELECT p_type, min(p_partkey) AS first, count(*) AS feature_count FROM part GROUP BY p_type)")
def category_mapping(spark, sf_dir):
    """Classes numbered as they first appear; the numbering needs no single task."""
    t = read(spark, sf_dir, "part").groupBy("p_type").agg(F.min("p_partkey").alias("first"), F.count("*").alias("feature_count"))
    return numbered(t, "first").select(F.col("p_type").alias("code"), (F.col("n") + 1).cast("int").alias("int_value"), "feature_count")


CITED = "['F0017111', 'E0011111 and F00171112', 'F001711123', 'nof0017111, (A0023001).', '7111', NULL]"


@query(rf"WITH t AS (SELECT doc_id, concat(substring(text, 1, 1000), ' ', {CITED}[doc_id % 6 + 1], ' ', substring(text, 1001)) AS text FROM documents), c AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b([A-Z][0-9]{{7,8}})\b', 1)) AS code FROM t) SELECT code, count(*) AS uses, count(DISTINCT doc_id) AS docs FROM c GROUP BY code")
def code_extract(spark, sf_dir):
    """Layer codes that texts cite, with their uses; every document is read whole."""
    cited = F.expr(f"array{CITED.replace('[', '(').replace(']', ')')}[doc_id % 6]")
    text = F.concat(F.substring("text", 1, 1000), F.lit(" "), F.coalesce(cited, F.lit("")), F.lit(" "), F.expr("substring(text, 1001)"))
    t = read(spark, sf_dir, "documents").select("doc_id", F.explode(records.codes_in(text)).alias("code"))
    return t.groupBy("code").agg(F.count("*").alias("uses"), F.count_distinct("doc_id").alias("docs"))


REMARKS = "['고분자 재료', '고분군 조사', 'gravel pit', 'two tombs', 'Cemeteries', '묘목', '묘지', NULL, 'no remark']"


@query(f"SELECT doc_id, coalesce(regexp_matches(replace(t, '고분자', ''), '{'|'.join(records.GRAVE_WORDS)}') OR regexp_matches(lower(t), '{records.GRAVE_ENGLISH}'), false) AS flagged FROM (SELECT doc_id, concat(substring(text, 1, 1000), ' ', {REMARKS}[doc_id % 9 + 1], ' ', substring(text, 1001)) AS t FROM documents)")
def keyword_flag(spark, sf_dir):
    """Texts with a grave word anywhere in them; every document is read whole."""
    remark = F.expr(f"array{REMARKS.replace('[', '(').replace(']', ')')}[doc_id % 9]")
    text = F.concat(F.substring("text", 1, 1000), F.lit(" "), F.coalesce(remark, F.lit("")), F.lit(" "), F.expr("substring(text, 1001)"))
    return read(spark, sf_dir, "documents").select("doc_id", records.speaks_of_graves(text).alias("flagged"))


@query("WITH rules AS (SELECT * FROM (VALUES ('Brand#11', 'road', 2.0::DOUBLE), ('Brand#12', 'river', 1.0::DOUBLE), ('Brand#23', 'building', 0.5::DOUBLE)) t(code, kind, width)) SELECT coalesce(kind, 'other') AS kind, count(*) AS features, CAST(sum(p_size) AS BIGINT) AS total_size, max(coalesce(width, 0.1)) AS width FROM part LEFT JOIN rules ON p_brand = code GROUP BY 1")
def style_rule_join(spark, sf_dir):
    """Features by the rule of their code; the rules are a fixed table of a few rows."""
    rules = spark.createDataFrame([("Brand#11", "road", 2.0), ("Brand#12", "river", 1.0), ("Brand#23", "building", 0.5)], "code string, kind string, width double")
    t = read(spark, sf_dir, "part").join(F.broadcast(rules), F.col("p_brand") == F.col("code"), "left")
    return t.groupBy(F.coalesce("kind", F.lit("other")).alias("kind")).agg(F.count("*").alias("features"), F.sum("p_size").alias("total_size"), F.max(F.coalesce("width", F.lit(0.1))).alias("width"))


@query("SELECT field, count(v) AS n, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean FROM (UNPIVOT (SELECT c_acctbal, CAST(c_nationkey AS DOUBLE) AS c_nationkey FROM customer) ON c_acctbal, c_nationkey INTO NAME field VALUE v) GROUP BY field")
def layer_stats_numeric(spark, sf_dir):
    t = read(spark, sf_dir, "customer").select("c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey")).unpivot([], ["c_acctbal", "c_nationkey"], "field", "v")
    return t.groupBy("field").agg(F.count("v").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.round(F.avg("v"), 6).alias("mean"))


@query("SELECT coalesce(p_type, '(null)') AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def layer_histogram_top20(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy(F.coalesce("p_type", F.lit("(null)")).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(20)


@query(f"WITH {SITES_SQL}, d AS (SELECT id, sqrt((x - 500) ** 2 + (y - 480) ** 2) AS m, (degrees(atan2(x - 500, y - 480)) + 360) % 360 AS bearing FROM sites) SELECT ['N','NE','E','SE','S','SW','W','NW'][CAST(floor((bearing + 22.5) / 45) AS INT) % 8 + 1] AS direction, count(*) AS sites, round(min(m), 6) AS nearest, round(avg(m), 6) AS mean, round(max(m), 6) AS farthest, count(*) FILTER (m <= 250) AS within FROM d GROUP BY 1")
def reference_relations(spark, sf_dir):
    """Known sites round a survey area's centre: by direction, with distances and how many are inside its radius."""
    t = sites(spark, sf_dir).select(F.sqrt((F.col("x") - 500) * (F.col("x") - 500) + (F.col("y") - 480) * (F.col("y") - 480)).alias("m"), F.pmod(F.degrees(F.atan2(F.col("x") - 500, F.col("y") - 480)), F.lit(360.0)).alias("bearing"))
    return t.groupBy(classes.compass8(F.col("bearing")).alias("direction")).agg(F.count("*").alias("sites"), F.round(F.min("m"), 6).alias("nearest"), F.round(F.avg("m"), 6).alias("mean"), F.round(F.max("m"), 6).alias("farthest"), F.count_if(F.col("m") <= 250).alias("within"))


TRENCH_SQL = f"""{NEAR_SQL}, {SITES_SQL}, cand AS (SELECT r * 100 + c AS id, c * 10 + 5 AS x, r * 10 + 5 AS y, {SLOPE_SQL} AS slope FROM nb),
ref AS (SELECT c.id, min(sqrt((c.x - s.x) ** 2 + (c.y - s.y) ** 2)) AS near FROM cand c LEFT JOIN sites s ON (c.x - s.x) ** 2 + (c.y - s.y) ** 2 <= 3600 GROUP BY c.id)"""


def _candidates(spark, sf_dir):
    slopes = raster.neighbourhood(dem(spark, sf_dir)).select((F.col("r") * 100 + F.col("c")).alias("id"), (F.col("c") * 10 + 5).alias("x"), (F.col("r") * 10 + 5).alias("y"), raster.slope(CELL).alias("slope")).where("slope IS NOT NULL")
    near = graph.nearest(slopes, sites(spark, sf_dir), 1, most=60.0).select(F.col("a").alias("id"), F.sqrt("d2").alias("near"))
    return slopes.join(near, "id", "left").select("id", "x", "y", decision.trench_score(F.col("slope"), F.col("near"), F.when(F.col("id") % 3 != 0, (F.col("id") % 101) / 100.0), steepest=90.0, radius=60.0).alias("score"))


@query(f"WITH {TRENCH_SQL}, p AS (SELECT id, x, y, greatest(0, least(1, 1 - slope / 90)) AS s, CASE WHEN near IS NOT NULL THEN greatest(0, least(1, 1 - near / 60)) END AS n, CASE WHEN id % 3 <> 0 THEN (id % 101) / 100.0::DOUBLE END AS q FROM cand JOIN ref USING (id)) SELECT id, x, y, round((0.55 * s + coalesce(0.25 * n, 0) + coalesce(0.2 * q, 0)) / (0.55 + CASE WHEN n IS NULL THEN 0 ELSE 0.25 END + CASE WHEN q IS NULL THEN 0 ELSE 0.2 END), 6) AS score FROM p")
def trench_candidates(spark, sf_dir):
    """Scores of candidate trenches by slope, the nearest known site within 60 m, and suitability where it is known."""
    return _candidates(spark, sf_dir).select("id", "x", "y", F.round("score", 6).alias("score"))


@query()
def trench_select(spark, sf_dir):
    """A dozen candidates that keep their distance, best of each square first; the greedy choice is tested apart."""
    return decision.spaced(_candidates(spark, sf_dir), 12, 60.0, 200.0)


@query("SELECT n_regionkey AS layer, count(*) AS features, max(n_nationkey * 41 % 900) AS xmin, min(n_nationkey * 41 % 900 + 800) AS xmax FROM nation GROUP BY 1")
def extent_intersection(spark, sf_dir):
    """The extent that all features of a layer share."""
    t = read(spark, sf_dir, "nation").selectExpr("n_regionkey AS layer", "n_nationkey * 41 % 900 AS xmin", "n_nationkey * 41 % 900 + 800 AS xmax")
    return t.groupBy("layer").agg(F.count("*").alias("features"), F.max("xmin").alias("xmin"), F.min("xmax").alias("xmax"))


@query("SELECT user_id, max(event_id) FILTER (event_type = 'purchase') IS NOT NULL AND max(event_id) FILTER (event_type = 'purchase') > coalesce(max(event_id) FILTER (event_type = 'signup'), -1) AND count(*) FILTER (event_type = 'error') = 0 AS succeeded, CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'fatal diagnostic' WHEN max(event_id) FILTER (event_type = 'purchase') IS NULL THEN 'no marker' WHEN max(event_id) FILTER (event_type = 'purchase') < coalesce(max(event_id) FILTER (event_type = 'signup'), -1) THEN 'diagnostic after marker' ELSE 'ok' END AS reason FROM events GROUP BY user_id")
def outcome_decision(spark, sf_dir):
    """Whether each run of a job succeeded: its marker came after every diagnostic, and none was fatal."""
    from ..sources.outcome import outcome

    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("marker"), (F.col("event_type") == "signup").alias("diagnostic"), (F.col("event_type") == "error").alias("fatal"))
    return outcome(e).select(F.col("run").alias("user_id"), "succeeded", "reason")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """Events by day and type; the function also takes a stream."""
    from ..streaming.events import activity

    return activity(read(spark, sf_dir, "events")).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))
