"""Queries on labels, scores, timetables, tags and hierarchies: each calls the library's function; the oracle spells the same out."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfield.functions import display, scoring, text
from wayfield.operators import census, graph, multires, service
from wayfield.plans.core import _edges, _nodes, _people
from wayfield.plans.layers import EDGES, NODES, PEOPLE, SIDE, STOPS, layer, with_layers
from wayfield.plans.registry import query, table
from wayfield.sources import osm


@query("p3_condense_rows", "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' OR o_orderstatus = '1-URGENT' THEN '1-URGENT' WHEN o_orderpriority = 'F' OR o_orderstatus = 'F' THEN 'F' END AS value, coalesce(o_orderstatus, o_orderpriority) AS first_value FROM orders")
def p3_condense_rows(spark, d):
    """The first listed value that any column has, and the first column that has one."""
    o = table(spark, d, "orders")
    listed = text.condensed(o, ["o_orderpriority", "o_orderstatus"], ["1-URGENT", "F"])
    return o.select("o_orderkey", listed.alias("value"), text.condensed(o, ["o_orderstatus", "o_orderpriority"]).alias("first_value"))


@query("p4_quality_text", "SELECT s_suppkey, printf('%d.%03d', k // 1000, k % 1000) AS quality FROM (SELECT s_suppkey, CAST(round(abs(s_acctbal) / CAST(7 AS DOUBLE) * 1000) AS BIGINT) AS k FROM supplier)")
def p4_quality_text(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", text.quality_text(F.abs("s_acctbal") / F.lit(7.0)).alias("quality"))


@query("p5_normalized", "SELECT p_partkey, strip_accents(lower(trim('  É' || p_name || 'çÑü '))) AS name FROM part")
def p5_normalized(spark, d):
    return table(spark, d, "part").select("p_partkey", text.normalize(F.concat(F.lit("  É"), "p_name", F.lit("çÑü "))).alias("name"))


@query("p6_sanitize", "SELECT p_partkey, regexp_replace(p_name, '[^A-Za-z0-9_-]', '_', 'g') AS name FROM part")
def p6_sanitize(spark, d):
    return table(spark, d, "part").select("p_partkey", text.sanitized(F.col("p_name")).alias("name"))


_SORTED = "list_aggregate(list_sort(string_split_regex(strip_accents(lower(trim({0}))), '\\s+')), 'string_agg', ' ')"


@query("p8_best_match", f"SELECT n_nationkey, n_name FROM (SELECT *, {_SORTED.format('n_name')} AS a, {_SORTED.format(chr(39) + 'Nation 07 the' + chr(39))} AS b FROM nation) ORDER BY CAST(strip_accents(lower(trim(n_name))) = 'nation 07 the' AS INT) DESC, 1 - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE) DESC, n_nationkey LIMIT 1")
def p8_best_match(spark, d):
    """The nation whose name is most like a text, words in any order."""
    return text.best_match(table(spark, d, "nation"), "n_name", "Nation 07 the", "n_nationkey").select("n_nationkey", "n_name")


_MIXED = "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'nan' WHEN 1 THEN 'None' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 3 = 0 THEN 'inf' WHEN c_custkey % 3 = 1 THEN CAST(CAST(c_custkey AS INT) AS VARCHAR) ELSE 'x' END AS amount FROM customer"


@query("p16_null_words", f"SELECT c_custkey, segment, amount FROM (SELECT c_custkey, CASE WHEN segment NOT IN ('nan', 'None') THEN segment END AS segment, CASE amount WHEN 'inf' THEN 0 ELSE TRY_CAST(amount AS DOUBLE) END AS amount FROM ({_MIXED})) WHERE segment IS NOT NULL OR amount IS NOT NULL")
def p16_null_words(spark, d):
    """Words for nothing become null, text becomes numbers, rows with nothing go."""
    c = table(spark, d, "customer")
    segment = F.when(F.col("c_custkey") % 4 == 0, "nan").when(F.col("c_custkey") % 4 == 1, "None").otherwise(F.col("c_mktsegment"))
    amount = F.when(F.col("c_custkey") % 3 == 0, "inf").when(F.col("c_custkey") % 3 == 1, F.col("c_custkey").cast("string")).otherwise("x")
    rows = c.select("c_custkey", segment.alias("segment"), text.number(amount).alias("amount"))
    return text.without_null_words(rows, ["segment", "amount"])


@query("q1_piecewise_score", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity = 10 THEN 1 ELSE pow(l_quantity / CAST(10 AS DOUBLE), CASE WHEN l_quantity >= 30 THEN CAST(-0.8 AS DOUBLE) WHEN l_quantity >= 8 THEN CAST(-0.35 AS DOUBLE) ELSE CAST(-0.1 AS DOUBLE) END) END, 6) AS score FROM lineitem")
def q1_piecewise_score(spark, d):
    score = scoring.elasticity_score(F.col("l_quantity").cast("double"), 10, [(8, -0.35), (None, -0.1), (30, -0.8)])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(score, 6).alias("score"))


_E = "(CAST(-0.3 AS DOUBLE) - x / 100)"


@query("q1_callable_score", """SELECT s_suppkey, round(CASE WHEN v = 10 THEN 1 ELSE exp(((list_extract(f, 1) + list_extract(f, 20)) / 2 + list_sum(f[2:19])) * (v - 10) / 19) END, 6) AS score FROM (
  SELECT s_suppkey, v, list_transform(range(20), lambda i: (CAST(-0.3 AS DOUBLE) - (10 + (v - 10) * i / CAST(19 AS DOUBLE)) / 100) / (10 + (v - 10) * i / CAST(19 AS DOUBLE))) AS f FROM (SELECT s_suppkey, abs(s_acctbal) / 500 + 1 AS v FROM supplier))""")
def q1_callable_score(spark, d):
    """An elasticity that changes with the value: the integral by trapezoids."""
    v = F.abs("s_acctbal") / 500 + 1
    score = scoring.elasticity_score(v, 10, lambda x: F.lit(-0.3) - x / 100, steps=20)
    return table(spark, d, "supplier").select("s_suppkey", F.round(score, 6).alias("score"))


_STOP = "pow({h} / CAST(5 AS DOUBLE), CAST(-0.35 AS DOUBLE)) * CASE {m} WHEN 'bus' THEN CAST(0.85 AS DOUBLE) WHEN 'tram' THEN CAST(0.92 AS DOUBLE) WHEN 'rail' THEN CAST(1 AS DOUBLE) END * pow({v} / CAST(150 AS DOUBLE), CAST(0.2 AS DOUBLE))"
_LOW, _HIGH = _STOP.format(h="CAST(720 AS DOUBLE)", m="'bus'", v="CAST(10 AS DOUBLE)"), _STOP.format(h="CAST(5 AS DOUBLE)", m="'rail'", v="CAST(30 AS DOUBLE)")


def _calibrated(x: str) -> str:
    return f"(CAST(0.1 AS DOUBLE) + ({x} - {_LOW}) * CAST(0.9 AS DOUBLE) / ({_HIGH} - {_LOW}))"


_MODE_SQL = "CASE mode WHEN 'click' THEN 'tram' WHEN 'signup' THEN 'rail' ELSE 'bus' END"


def _timetable(spark, d):
    """Departures of the derived stops: minute of the day, mode, direction and speed."""
    s = layer(spark, d, STOPS, name="stops")
    mode = F.when(F.col("mode") == "click", "tram").when(F.col("mode") == "signup", "rail").otherwise("bus")
    minute = (F.unix_micros(F.col("ts").cast("timestamp")) / 60000000).alias("minute")
    return s.select("stop", (F.col("event_id") % 2).alias("direction"), mode.alias("mode"), (F.abs("value") / 4).alias("speed"), minute)


@query("q9_stop_scores", with_layers(
    STOPS, f"t AS (SELECT stop, event_id % 2 AS direction, {_MODE_SQL} AS mode, abs(value) / 4 AS speed, epoch_us(ts) / CAST(60000000 AS DOUBLE) AS minute FROM stops)",
    "bands AS (SELECT t.*, high FROM t JOIN (VALUES (5, 15), (15, 30), (30, 60)) b(low, high) ON speed >= low)",
    "gaps AS (SELECT stop, direction, mode, high, minute - lag(minute) OVER (PARTITION BY stop, direction, mode, high ORDER BY minute) AS gap FROM bands)",
    "heads AS (SELECT stop, mode, high, min(headway) AS headway FROM (SELECT stop, direction, mode, high, avg(gap) AS headway FROM gaps GROUP BY 1, 2, 3, 4) WHERE headway IS NOT NULL GROUP BY 1, 2, 3)",
    f"scored AS (SELECT *, {_calibrated(_STOP.format(h='headway', m='mode', v='high'))} AS score FROM heads)",
    body="SELECT stop, arg_max(mode, (round(score, 9), mode)) AS mode, round(max(score), 5) AS score FROM scored GROUP BY stop",
))
def q9_stop_scores(spark, d):
    """Each stop's best score over modes and speed bands, from headways of its best direction."""
    got = service.stop_scores(_timetable(spark, d), "stop", "direction", "mode", "speed", "minute", [5, 15, 30, 60], [60, 720, 1440, 10000])
    return got.select("stop", "mode", F.round("score", 5).alias("score"))


@query("q8_access_score", f"SELECT s_suppkey, round({_calibrated(_STOP.format(h='(s_suppkey % 60 + 5) / CAST(1 AS DOUBLE)', m='mode', v='(s_suppkey % 100 + 10) / CAST(1 AS DOUBLE)'))}, 6) AS stop FROM (SELECT s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN 'bus' WHEN 1 THEN 'tram' ELSE 'rail' END AS mode FROM supplier)")
def q8_access_score(spark, d):
    s = table(spark, d, "supplier")
    mode = F.when(F.col("s_nationkey") % 3 == 0, "bus").when(F.col("s_nationkey") % 3 == 1, "tram").otherwise("rail")
    stop = scoring.TransitScore().stop()((F.col("s_suppkey") % 60 + 5).cast("double"), mode, (F.col("s_suppkey") % 100 + 10).cast("double"))
    return s.select("s_suppkey", F.round(stop, 6).alias("stop"))


@query("q10_score_matrix", """WITH s AS (SELECT DISTINCT CAST(s_nationkey + 1 AS DOUBLE) / 25 AS score FROM supplier), m AS (SELECT score, d, score * (1 - d / CAST(2000 AS DOUBLE)) AS v FROM s CROSS JOIN (VALUES (100), (500), (1000)) t(d)),
g AS (SELECT score, d, CASE WHEN v <= CAST(0.25 AS DOUBLE) THEN 0.25 WHEN v <= CAST(0.5 AS DOUBLE) THEN 0.5 WHEN v <= CAST(0.75 AS DOUBLE) THEN 0.75 ELSE 1.0 END AS v FROM m)
SELECT score, CAST(max(v) FILTER (WHERE d = 100) AS DOUBLE) AS d100, CAST(max(v) FILTER (WHERE d = 500) AS DOUBLE) AS d500, CAST(max(v) FILTER (WHERE d = 1000) AS DOUBLE) AS d1000 FROM g GROUP BY score""")
def q10_score_matrix(spark, d):
    """Distinct stop scores at given distances, snapped up to a grid, one column per distance."""
    stops = table(spark, d, "supplier").select(((F.col("s_nationkey") + 1).cast("double") / 25).alias("score"))
    matrix = scoring.score_matrix(stops, "score", [100, 500, 1000], lambda s, x: s * (1 - x / F.lit(2000.0)), [0.25, 0.5, 0.75, 1.0])
    return scoring.pivoted(matrix, [100, 500, 1000])


_BAND = """cut AS (SELECT {k} AS g, quantile_cont(v, CAST(0.9 AS DOUBLE)) * CAST(0.5 AS DOUBLE) AS low FROM days GROUP BY 1), kept AS (SELECT days.*, {k} AS g FROM days JOIN cut ON cut.g = {k} WHERE v >= low AND v > 0),
ends AS (SELECT g, CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo, CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM kept GROUP BY g),
binned AS (SELECT kept.*, lo, hi, CAST(least(floor((v - lo) / (hi - lo) * 5), 4) AS INT) AS bin FROM kept JOIN ends USING (g)),
counts AS (SELECT g, bin, count(*) AS n FROM binned GROUP BY 1, 2), modal AS (SELECT g, min(bin) AS b0, max(bin) AS b1 FROM (SELECT *, max(n) OVER (PARTITION BY g) AS most FROM counts) WHERE n = most GROUP BY g),
inside AS (SELECT binned.* FROM binned JOIN modal USING (g) WHERE v >= lo + b0 * (hi - lo) / 5 AND v <= lo + (b1 + 1) * (hi - lo) / 5),
stats AS (SELECT g, CAST(sum(CAST(v AS BIGINT)) AS BIGINT) AS s, CAST(sum(CAST(v AS BIGINT) * CAST(v AS BIGINT)) AS BIGINT) AS q, count(*) AS n FROM inside GROUP BY g),
band AS (SELECT inside.*, CAST(s AS DOUBLE) / n AS m FROM inside JOIN stats USING (g) WHERE (n * CAST(v AS BIGINT) - s) * (n * CAST(v AS BIGINT) - s) <= n * q - s * s)"""
_DAYS = "days AS (SELECT CAST(ts AS DATE) AS day, event_type AS feed, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1, 2)"


def _days(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.col("ts").cast("date").alias("day"), F.col("event_type").alias("feed")).agg(F.count("*").cast("double").alias("v"))


@query("a17_modal_band", f"WITH {_DAYS}, {_BAND.format(k='feed')} SELECT feed, day, v, round(m, 6) AS band_mean FROM band")
def a17_modal_band(spark, d):
    """Usual days of each feed: by the fullest bins of a histogram, within one deviation of their mean."""
    return service.modal_band(_days(spark, d), "v", "feed").select("feed", "day", "v", F.round("band_mean", 6).alias("band_mean"))


@query("a18_representative", f"WITH {_DAYS}, {_BAND.format(k='feed')} SELECT day, v FROM band ORDER BY v DESC, day LIMIT 1")
def a18_representative(spark, d):
    return service.representative(_days(spark, d).withColumn("day", F.col("day")), "v", "day", "feed").select("day", "v")


_TAGS = """SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN 'restaurant' WHEN 1 THEN 'pub' WHEN 2 THEN 'healthcare_centre' WHEN 3 THEN 'gym' WHEN 4 THEN 'fast_food;cafe' WHEN 5 THEN 'marketplace' WHEN 6 THEN 'school' END AS amenity,
  CASE p_partkey % 5 WHEN 0 THEN 'supermarket' WHEN 1 THEN 'greengrocer' WHEN 2 THEN 'convenience' END AS shop, CASE p_partkey % 6 WHEN 0 THEN 'park' WHEN 1 THEN 'sports_centre' END AS leisure,
  CASE p_partkey % 7 WHEN 0 THEN 'greenfield' WHEN 1 THEN 'village_green' WHEN 2 THEN 'grass' END AS landuse FROM part"""


@query("s5_places", f"""WITH t AS ({_TAGS}) SELECT 'green_areas' AS kind, count(*) AS n FROM t WHERE leisure IN ('garden', 'park') OR landuse IN ('greenfield', 'grass', 'forest')
UNION ALL SELECT 'schools', count(*) FROM t WHERE amenity = 'school' UNION ALL SELECT 'healthcare', count(*) FROM t WHERE regexp_matches(amenity, 'hospital|clinic|doctors|healthcare')
UNION ALL SELECT 'groceries', count(*) FROM t WHERE regexp_matches(shop, 'supermarket|grocery|convenience') OR amenity = 'marketplace' UNION ALL SELECT 'shops', count(*) FROM t WHERE shop IS NOT NULL
UNION ALL SELECT 'restaurants', count(*) FROM t WHERE regexp_matches(amenity, 'restaurant|bar|pub|cafe|fast_food') UNION ALL SELECT 'gyms', count(*) FROM t WHERE amenity = 'gym'""")
def s5_places(spark, d):
    """How many elements each kind of place has."""
    p = F.col("p_partkey")
    pick = lambda m, values: F.get(F.array(*(F.lit(v) for v in values)), (p % m).cast("int"))
    named = [("amenity", pick(8, ["restaurant", "pub", "healthcare_centre", "gym", "fast_food;cafe", "marketplace", "school"])), ("shop", pick(5, ["supermarket", "greengrocer", "convenience"])), ("leisure", pick(6, ["park", "sports_centre"])), ("landuse", pick(7, ["greenfield", "village_green", "grass"]))]
    tags = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in named)), lambda e: e["v"].isNotNull()))
    elements = table(spark, d, "part").select(p.alias("id"), tags.alias("tags"))
    kinds = ["green_areas", "schools", "healthcare", "groceries", "shops", "restaurants", "gyms"]
    parts = [osm.places(elements, k).agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k in kinds]
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


_HIGHWAYS = ["motorway", "trunk", "secondary", "residential", "cycleway", "steps", "road", "track"]


@query("s19_networks", "WITH w AS (SELECT p_partkey AS way, [" + ", ".join(f"'{h}'" for h in _HIGHWAYS) + "][p_partkey % 8 + 1] AS h, CASE WHEN p_partkey % 11 = 0 THEN 'yes' WHEN p_partkey % 11 = 1 THEN 'designated' END AS foot FROM part)" + """
SELECT 'walk' AS profile, count(*) AS n FROM w WHERE h IN ('residential', 'steps', 'track') OR foot = 'yes' UNION ALL SELECT 'bike', count(*) FROM w WHERE h IN ('residential', 'cycleway', 'track')
UNION ALL SELECT 'drive', count(*) FROM w WHERE h IN ('motorway', 'trunk', 'secondary', 'residential') UNION ALL SELECT 'walk+bike', count(*) FROM w WHERE h IN ('residential', 'steps', 'track', 'cycleway') OR foot = 'yes'
UNION ALL SELECT 'walk+bike+primary', count(*) FROM w WHERE h IN ('residential', 'steps', 'track', 'cycleway', 'trunk', 'secondary') OR foot = 'yes' UNION ALL SELECT 'all', count(*) FROM w""")
def s19_networks(spark, d):
    """How many ways each network profile takes."""
    p = F.col("p_partkey")
    foot = F.when(p % 11 == 0, "yes").when(p % 11 == 1, "designated")
    highway = F.element_at(F.array(*(F.lit(h) for h in _HIGHWAYS)), (p % 8 + 1).cast("int"))
    tags = F.map_from_entries(F.filter(F.array(F.struct(F.lit("highway").alias("k"), highway.alias("v")), F.struct(F.lit("foot").alias("k"), foot.alias("v"))), lambda e: e["v"].isNotNull()))
    ways = table(spark, d, "part").select(p.alias("way"), tags.alias("tags"))
    out = None
    for name in ("walk", "bike", "drive", "walk+bike", "walk+bike+primary", "all"):
        one = osm.network(ways, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("profile"), "n")
        out = one if out is None else out.union(one)
    return out


_COUNTS = "SELECT c_nationkey AS geoid, count(*) AS universe, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS building, count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS machinery FROM customer GROUP BY 1"


def _counts(spark, d):
    count = lambda s: F.count(F.when(F.col("c_mktsegment") == s, 1))
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("geoid")).agg(F.count("*").alias("universe"), count("BUILDING").alias("building"), count("MACHINERY").alias("machinery"))


@query("a9_ratios", f"SELECT geoid, universe, round(CAST(building AS DOUBLE) / universe, 6) AS building_ratio, round(building / CAST(2.5 AS DOUBLE), 6) AS building_density, round(machinery / CAST(2.5 AS DOUBLE), 6) AS machinery_density FROM ({_COUNTS})")
def a9_ratios(spark, d):
    """Ratios to a universe and densities, as each field's universe says."""
    rows = census.ratios(_counts(spark, d).withColumn("km2", F.lit(2.5)), {"building": "universe", "machinery": "DENSITY_ONLY", "universe": "NO_DENSITY_OR_RATIO"}, "km2")
    return rows.select("geoid", "universe", *(F.round(c, 6).alias(c) for c in ("building_ratio", "building_density", "machinery_density")))


@query("a10_weighted_mean", f"SELECT n_regionkey, CAST(sum(universe) AS BIGINT) AS universe, round(sum(building * universe) / CAST(sum(universe) AS DOUBLE), 6) AS building FROM ({_COUNTS}) JOIN nation ON geoid = n_nationkey GROUP BY 1")
def a10_weighted_mean(spark, d):
    """Counts summed and rates averaged by weight, up to regions."""
    up = _counts(spark, d).join(table(spark, d, "nation"), F.col("geoid") == F.col("n_nationkey"))
    return census.resample(up, "n_regionkey", ["universe"], {"building": "universe"}).select("n_regionkey", "universe", F.round("building", 6).alias("building"))


@query("w1_edge_key", "SELECT o_custkey AS u, c_nationkey AS v, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey, c_nationkey ORDER BY o_orderdate, o_orderkey) - 1 AS INT) AS key_no FROM orders JOIN customer ON c_custkey = o_custkey")
def w1_edge_key(spark, d):
    """Parallel edges numbered per pair of ends, in a total order."""
    orders = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    edges = orders.select(F.col("o_custkey").alias("u"), F.col("c_nationkey").alias("v"), "o_orderkey", "o_orderdate")
    return graph.keyed(edges, "o_orderdate", "o_orderkey").select("u", "v", "o_orderkey", "key_no")


@query("p2_crop_nodes", with_layers(SIDE, NODES, EDGES, "kept AS (SELECT u, v FROM edges JOIN nodes a ON a.id = u JOIN nodes b ON b.id = v JOIN side ON true WHERE a.x < n * 60 OR b.x < n * 60)", body="SELECT id, x, y FROM nodes WHERE id IN (SELECT u FROM kept UNION SELECT v FROM kept)"))
def p2_crop_nodes(spark, d):
    """Edges with an end in the western part, then the nodes that they have."""
    n = _nodes(spark, d)
    west = n.agg(F.max("col") + 1).first()[0] * 60
    nodes, _ = graph.crop(n, _edges(spark, d), n.filter(F.col("x") < west).select("id"))
    return nodes.select("id", "x", "y")


@query("a12_propagate_down", "SELECT n_nationkey, round(total / CAST(count(*) OVER (PARTITION BY n_regionkey) AS DOUBLE), 6) AS total FROM nation JOIN (SELECT n_regionkey, sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) USING (n_regionkey)")
def a12_propagate_down(spark, d):
    """A region's sum, rolled up from customers, shared evenly among its nations."""
    nation = table(spark, d, "nation")
    money = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey", F.round(F.col("c_acctbal") * 100).cast("long").alias("total"))
    regions = multires.roll_up(money, "n_regionkey", "total")
    return multires.roll_down(regions, nation, "n_regionkey", "total").select("n_nationkey", F.round("total", 6).alias("total"))


@query("a14_statistics", with_layers(SIDE, PEOPLE, body="""SELECT CASE WHEN grouping(segment) = 1 THEN 'total' ELSE segment END AS segment, CAST(sum(population) AS BIGINT) AS population,
  round(100.0 * sum(population) / max(sum(population)) OVER (), 2) AS percent FROM people GROUP BY ROLLUP (segment)"""))
def a14_statistics(spark, d):
    """Population by label, the total, and percents."""
    return census.statistics(_people(spark, d), "segment", "population", "total")


@query("v1_marker_radius", "SELECT s_suppkey, round(CASE WHEN p > 0 THEN 12 * least(greatest(s_acctbal, 0), p) / p ELSE 12 END, 6) AS radius FROM supplier CROSS JOIN (SELECT quantile_cont(s_acctbal, CAST(0.9 AS DOUBLE)) AS p FROM supplier)")
def v1_marker_radius(spark, d):
    return display.with_radius(table(spark, d, "supplier"), "s_acctbal").select("s_suppkey", F.round("radius", 6).alias("radius"))


@query("j18_stop_speeds", with_layers(STOPS, "sp AS (SELECT stop, mode, avg(value) AS speed FROM stops WHERE value > 0 GROUP BY 1, 2)", body="SELECT event_id, round(speed, 6) AS speed FROM stops LEFT JOIN sp ON sp.stop = stops.stop AND sp.mode = stops.mode AND stops.event_id % 3 > 0"))
def j18_stop_speeds(spark, d):
    """Speeds of stop and trip onto stop times, null where none is known."""
    s = layer(spark, d, STOPS, name="stops")
    trip = F.when(F.col("event_id") % 3 > 0, F.col("mode"))
    speeds = s.filter("value > 0").groupBy("stop", "mode").agg(F.avg("value").alias("speed")).withColumnRenamed("mode", "trip")
    return service.with_speeds(s.withColumn("trip", trip), speeds, ["stop", "trip"]).select("event_id", F.round("speed", 6).alias("speed"))


@query("a16_stop_speed", with_layers(STOPS, body="""SELECT stop, round(sum(abs(value) * n) / sum(n), 6) AS speed, count(DISTINCT mode) AS n_modes, bool_or(value > 100) AS any_inside FROM (
  SELECT stop, mode, value, event_id % 7 + 1 AS n FROM stops) GROUP BY stop"""))
def a16_stop_speed(spark, d):
    """Mean absolute speed by trips, number of modes, and whether any departure is fast, per stop."""
    s = layer(spark, d, STOPS, name="stops").withColumns({"n": F.col("event_id") % 7 + 1, "fast": F.col("value") > 100})
    return service.stop_speeds(s, "stop", "value", "n", "mode", "fast").withColumn("speed", F.round("speed", 6))


@query("c1_multires_layers", with_layers(SIDE, PEOPLE, body="SELECT nation, segment, CAST(sum(population) AS BIGINT) AS people, round(max(jobs) / CAST(count(*) OVER (PARTITION BY nation) AS DOUBLE), 4) AS jobs FROM people JOIN (SELECT s_nationkey AS nation, count(*) AS jobs FROM supplier GROUP BY 1) USING (nation) GROUP BY nation, segment"))
def c1_multires_layers(spark, d):
    """Nations, segments of a nation, people: population goes up, suppliers come down, shared evenly."""
    people = _people(spark, d).select("nation", F.concat_ws("|", "nation", "segment").alias("part"), F.col("population").alias("people"))
    parts = _people(spark, d).select("nation", "segment", F.concat_ws("|", "nation", "segment").alias("part")).distinct()
    jobs = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("jobs"))
    layers = multires.MultiresLayers([jobs, parts, people], ["nation", "part", ""], {"people": "sum", "jobs": "sum"})
    return layers[1].filter("jobs IS NOT NULL").select("nation", "segment", "people", F.round("jobs", 4).alias("jobs"))


_HALVED = "CAST(ceil(log2({0} * {1} / CAST(0.5 AS DOUBLE))) AS BIGINT)"


@query("q3_adaptive_grids", f"""WITH b AS (SELECT CAST(min(l_quantity) AS DOUBLE) AS a0, CAST(max(l_quantity) AS DOUBLE) AS a1, CAST(min(l_discount) AS DOUBLE) AS b0, CAST(max(l_discount) AS DOUBLE) AS b1 FROM lineitem),
h AS (SELECT *, power(2, {_HALVED.format('(a1 - a0)', 'b1')}) AS na, power(2, {_HALVED.format('(b1 - b0)', 'a1')}) AS nb FROM b)
SELECT 'quantity' AS axis, round(a0 + (a1 - a0) * i / na, 9) AS value FROM h, (SELECT unnest(range(0, 4096)) AS i) WHERE i <= na UNION ALL SELECT 'discount', round(b0 + (b1 - b0) * i / nb, 9) FROM h, (SELECT unnest(range(0, 4096)) AS i) WHERE i <= nb""")
def q3_adaptive_grids(spark, d):
    """Grids of quantity and discount between which their product changes by 0.5 at most, whatever the other is."""
    ends = table(spark, d, "lineitem").agg(*(f(c).cast("double") for c in ("l_quantity", "l_discount") for f in (F.min, F.max))).first()
    grids = scoring.adaptive_grids(lambda quantity, discount: quantity * discount, {"quantity": (ends[0], ends[1]), "discount": (ends[2], ends[3])}, 0.5)
    return spark.createDataFrame([(k, v) for k, grid in grids.items() for v in grid], "axis string, value double").withColumn("value", F.round("value", 9))
