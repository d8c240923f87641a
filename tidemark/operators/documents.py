"""Queries over JSON, full-text and spatial functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import fulltext as X
from tidemark.functions import jsons as J
from tidemark.functions import spatial as G
from tidemark.registry import op
from tidemark.session import table

c = F.col


def rows(spark: SparkSession, values: str, names: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM (VALUES {values}) AS t({names})")


# -- JSON (2.14), JSON_TABLE (2.1), JSON aggregates (2.5) ---------------------------------------------------------
@op("json_extract_events", "SELECT event_id, json_extract_string(props, '$.' || list_extract(json_keys(props), 1)) AS first_value, json_valid(props)::INT AS ok, len(json_keys(props))::INT AS n FROM events")
def extract_events(spark, sf_dir):
    p = c("props")
    first = F.json_object_keys(p)[0]
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json(p), F.concat(F.lit("$."), first), "string").alias("first_value"), J.json_valid(p).alias("ok"), F.size(F.json_object_keys(p)).alias("n"))


_DOCS = """('{"a": 1, "b": [1, 2, {"c": "x"}], "d": {"e": null}}'), ('[3, "y", true]'), ('"s"'), ('12.5'), ('null'), ('{bad'), (NULL)"""


@op("json_attributes", """SELECT * FROM (VALUES
 ('{"a": 1, "b": [1, 2, {"c": "x"}], "d": {"e": null}}', 1, 'OBJECT', 4, 3, '["a","b","d"]', '1', '[1, 2, {"c": "x"}]'), ('[3, "y", true]', 1, 'ARRAY', 2, 3, NULL, NULL, NULL), ('"s"', 1, 'STRING', 1, 1, NULL, NULL, NULL),
 ('12.5', 1, 'DOUBLE', 1, 1, NULL, NULL, NULL), ('null', 1, 'NULL', 1, 1, NULL, NULL, NULL), ('{bad', 0, NULL, NULL, NULL, NULL, NULL, NULL), (NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL)) t(doc, ok, kind, deep, n, ks, a, b)""")
def attributes(spark, sf_dir):
    d = c("doc")
    return rows(spark, _DOCS, "doc").select("doc", J.json_valid(d).alias("ok"), J.json_type(d).alias("kind"), J.json_depth(d).alias("deep"), J.json_length(d).alias("n"), J.json_keys(d).alias("ks"), J.json_extract(d, "$.a").alias("a"), J.json_extract(d, "$.b").alias("b"))


_ONE = """('{"a": 1, "b": [1, 2]}')"""


@op("json_edit", """SELECT '{"a": 10, "b": [1, 2], "c": true}' AS set_, '{"a": 1, "b": [1, 2], "c": 3}' AS ins, '{"a": 10, "b": [1, 2]}' AS rep, '{"b": [1]}' AS rem, '{"a": [1, 5], "b": [1, 2, 3]}' AS app, '{"a": 1, "b": [0, 1, 2]}' AS arr, '{"a": [1, 2], "b": [1, 2], "z": 0}' AS mp, '{"b": [1, 2], "z": 0}' AS pat""")
def edits(spark, sf_dir):
    d = c("doc")
    return rows(spark, _ONE, "doc").select(J.json_set(d, "$.a", 10, "$.c", True).alias("set_"), J.json_insert(d, "$.a", 10, "$.c", 3).alias("ins"), J.json_replace(d, "$.a", 10, "$.c", 3).alias("rep"), J.json_remove(d, "$.a", "$.b[1]").alias("rem"), J.json_array_append(d, "$.a", 5, "$.b", 3).alias("app"), J.json_array_insert(d, "$.b[0]", 0).alias("arr"), J.json_merge_preserve(d, {"a": 2, "z": 0}).alias("mp"), J.json_merge_patch(d, {"a": None, "z": 0}).alias("pat"))


@op("json_search_contain", """SELECT true AS has1, false AS has9, true AS path_one, false AS path_all, '"$.b[2].c"' AS found, true AS over, '[1, 1, 2, {"c": "xyz"}]' AS wild, '["xyz"]' AS deep, 'xyz' AS val, -1 AS dflt, true AS mem""")
def search_contain(spark, sf_dir):
    d = c("doc")
    return rows(spark, """('{"a": 1, "b": [1, 2, {"c": "xyz"}]}')""", "doc").select(
        J.json_contains(d, 1, "$.a").alias("has1"), J.json_contains(d, 9, "$.b").alias("has9"), J.json_contains_path(d, "one", "$.a", "$.z").alias("path_one"), J.json_contains_path(d, "all", "$.a", "$.z").alias("path_all"), J.json_search(d, "one", "x%").alias("found"), J.json_overlaps(d, {"a": 1}).alias("over"), J.json_extract(d, "$.a", "$.b[*]").alias("wild"), J.json_extract(d, "$**.c").alias("deep"), J.json_value(d, "$.b[2].c").alias("val"), J.json_value(d, "$.none", "int", -1).alias("dflt"), J.member_of(F.lit(2), F.lit("[1, 2, 3]"), "int").alias("mem"))


@op("json_construct", "SELECT n_nationkey AS k, '{\"k\":' || n_nationkey || ',\"name\":\"' || n_name || '\",\"none\":null}' AS o, '\"' || n_name || '\"' AS q, n_name AS u, (strlen(n_name) + 2)::INT AS size, 0 AS free FROM nation")
def construct(spark, sf_dir):
    k, n = c("n_nationkey"), c("n_name")
    return table(spark, sf_dir, "nation").select(k.alias("k"), J.json_object("k", k, "name", n, "none", F.lit(None).cast("string")).alias("o"), J.json_quote(n).alias("q"), J.json_unquote(J.json_quote(n)).alias("u"), J.json_storage_size(J.json_quote(n)).alias("size"), J.json_storage_free(J.json_quote(n)).alias("free"))


@op("json_schema", """SELECT * FROM (VALUES ('{"a": 3}', true, '{"valid": true}'), ('{"a": 30}', false, '{"valid": false, "document-location": "#/a", "schema-failed-keyword": "maximum"}'), ('{}', false, '{"valid": false, "document-location": "#", "schema-failed-keyword": "required"}')) t(doc, ok, rep)""")
def schema(spark, sf_dir):
    rule = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "maximum": 9}}}
    d = c("doc")
    return rows(spark, """('{"a": 3}'), ('{"a": 30}'), ('{}')""", "doc").select("doc", J.json_schema_valid(rule, d).alias("ok"), J.json_schema_validation_report(rule, d).alias("rep"))


@op("json_pretty", "SELECT '{' || chr(10) || '  \"a\": 1,' || chr(10) || '  \"b\": [' || chr(10) || '    1,' || chr(10) || '    2' || chr(10) || '  ]' || chr(10) || '}' AS p")
def pretty(spark, sf_dir):
    return rows(spark, _ONE, "doc").select(J.json_pretty(c("doc")).alias("p"))


@op("json_table", "SELECT * FROM (VALUES (1, 'x', 1, true), (2, NULL, 2, false), (3, 'z', 3, true)) t(ord, name, qty, has_name)")
def json_table(spark, sf_dir):
    """JSON_TABLE: FOR ORDINALITY, PATH and EXISTS PATH columns of a top-level array."""
    doc = """('[{"name": "x", "qty": 1}, {"qty": 2}, {"name": "z", "qty": 3}]')"""
    cells = rows(spark, doc, "doc").select(F.posexplode(F.from_json("doc", "array<struct<name: string, qty: int>>")))
    return cells.select((c("pos") + 1).alias("ord"), c("col.name").alias("name"), c("col.qty").alias("qty"), c("col.name").isNotNull().alias("has_name"))


@op("json_table_nested", "SELECT * FROM (VALUES (1, 1, 'x', 1, 1, 1, 10), (1, 1, 'x', 1, 1, 2, 20), (1, 2, NULL, -1, 0, NULL, NULL), (1, 3, 'z', 0, 1, 1, NULL), (2, 1, 'w', 7, 1, NULL, NULL)) t(k, ord, name, qty, has_name, part, size)")
def json_table_nested(spark, sf_dir):
    """JSON_TABLE over a table's documents: row path, NESTED PATH, defaults ON EMPTY (-1) and ON ERROR (0)."""
    docs = """(1, '{"r": [{"name": "x", "qty": 1, "p": [{"s": 10}, {"s": 20}]}, {"p": []}, {"name": "z", "qty": "no", "p": [{"s": null}]}]}'), (2, '{"r": [{"name": "w", "qty": 7}]}'), (3, '{}'), (4, NULL), (5, '{bad')"""
    return J.json_table(
        rows(spark, docs, "k, doc"), "doc", "$.r[*]", J.Ordinality("ord"), J.PathColumn("name", "string", "$.name"), J.PathColumn("qty", "int", "$.qty", -1, 0), J.ExistsColumn("has_name", "$.name"), J.Nested("$.p[*]", (J.Ordinality("part"), J.PathColumn("size", "int", "$.s")))
    ).drop("doc")


@op("json_table_events", "SELECT event_id, 1 AS ord, json_extract_string(props, '$.k')::INT AS k, (json_extract_string(props, '$.k') IS NOT NULL)::INT AS has_k FROM events")
def json_table_events(spark, sf_dir):
    """JSON_TABLE over every event, each document one row."""
    events = table(spark, sf_dir, "events").select("event_id", "props")
    return J.json_table(events, "props", "$", J.Ordinality("ord"), J.PathColumn("k", "int", "$.k"), J.ExistsColumn("has_k", "$.k")).drop("props")


@op("agg_json_arrays_objects", "SELECT n_regionkey AS r, '[' || string_agg(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey::VARCHAR ELSE 'null' END, ',' ORDER BY CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END NULLS FIRST) || ']' AS a, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS o FROM nation GROUP BY n_regionkey")
def agg_json(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy(c("n_regionkey").alias("r")).agg(J.json_arrayagg(F.when(c("n_nationkey") % 2 == 0, c("n_nationkey"))).alias("a"), J.json_objectagg(c("n_name"), c("n_nationkey")).alias("o"))


@op("window_json_arrayagg", "SELECT n_nationkey AS k, '[' || string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) OVER (PARTITION BY n_regionkey) || ']' AS a FROM nation")
def window_json(spark, sf_dir):
    from pyspark.sql.window import Window

    held = F.collect_list(F.struct(c("n_nationkey").alias("x"))).over(Window.partitionBy("n_regionkey"))
    return table(spark, sf_dir, "nation").select(c("n_nationkey").alias("k"), F.to_json(F.transform(F.array_sort(held), lambda s: s.x)).alias("a"))


@op("window_json_objectagg", "SELECT n_nationkey AS k, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) OVER (PARTITION BY n_regionkey) || '}' AS o FROM nation")
def window_json_objects(spark, sf_dir):
    """JSON_OBJECTAGG OVER: the keys of the window's rows in order."""
    from pyspark.sql.window import Window

    pairs = F.collect_list(F.struct(c("n_name").alias("k"), c("n_nationkey").alias("v"))).over(Window.partitionBy("n_regionkey"))
    return table(spark, sf_dir, "nation").select(c("n_nationkey").alias("k"), F.to_json(F.map_from_entries(F.array_sort(pairs))).alias("o"))


# -- full text (2.17) ---------------------------------------------------------------------------------------------
_TOK = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}_'']+'), lambda w: length(w) >= 3 AND w NOT IN ('about', 'are', 'com', 'for', 'from', 'how', 'that', 'the', 'this', 'was', 'what', 'when', 'where', 'who', 'will', 'with', 'und', 'www'))"
_QUERY = "thing then heing nation"


@op("fulltext_natural_language", f"SELECT doc_id, round(len(list_filter({_TOK}, lambda w: w IN ('thing', 'then', 'heing', 'nation'))) * {X.BASE}::DOUBLE, 9) AS score FROM documents")
def natural(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(X.natural_score(c("text"), _QUERY), 9).alias("score"))


@op("fulltext_bm25", f"""WITH d AS (SELECT doc_id, {_TOK} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
h AS (SELECT doc_id, len(w) AS length, word, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS word FROM d) x WHERE word IN ('thing', 'then', 'heing', 'nation') GROUP BY ALL),
f AS (SELECT word, count(*) AS df FROM h GROUP BY word)
SELECT doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 9) AS score FROM h JOIN f USING (word), s GROUP BY doc_id""")
def bm25(spark, sf_dir):
    return X.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", _QUERY).select("doc_id", F.round("score", 9).alias("score"))


@op("fulltext_boolean_mode", f"SELECT doc_id, (list_contains(w, 'thing') AND NOT list_contains(w, 'then')) AS a, (len(list_filter(w, lambda x: x LIKE 'tion%')) > 0 OR list_contains(w, 'heing')) AS b, regexp_matches(lower(coalesce(text, '')), '(^|[^\\p{{L}}\\p{{N}}_])of[^\\p{{L}}\\p{{N}}_]+the($|[^\\p{{L}}\\p{{N}}_])') AS p FROM (SELECT doc_id, text, {_TOK} AS w FROM documents) d")
def boolean_mode(spark, sf_dir):
    t = c("text")
    return table(spark, sf_dir, "documents").select("doc_id", X.boolean_match(t, "+thing -then").alias("a"), X.boolean_match(t, "tion* heing").alias("b"), X.boolean_match(t, '"of the"').alias("p"))


@op("fulltext_boolean_relevance", f"""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t, {_TOK} AS w FROM documents),
x AS (SELECT doc_id, list_contains(w, 'thing')::INT AS th, list_contains(w, 'then')::INT AS tn, list_contains(w, 'nation')::INT AS na, len(list_filter(w, lambda y: y LIKE 'tion%')) AS ti, (t LIKE '%of the%')::INT AS ph FROM d)
SELECT doc_id, (CASE WHEN th = 1 AND tn = 0 THEN 1 + 2 * na ELSE 0 END)::DOUBLE AS a, round(CASE WHEN ti > 0 OR ph = 1 THEN {X.BASE}::DOUBLE * ti + 0.5 * ph ELSE 0 END::DOUBLE, 9) AS b, round(CASE WHEN th = 1 THEN 1 + CASE WHEN tn = 1 THEN -0.5 ELSE {X.BASE}::DOUBLE END ELSE 0 END::DOUBLE, 9) AS c FROM x""")
def boolean_relevance(spark, sf_dir):
    """Relevance in boolean mode: signs, a prefix, a phrase."""
    t = c("text")
    return table(spark, sf_dir, "documents").select("doc_id", X.boolean_score(t, "+thing -then >nation").alias("a"), F.round(X.boolean_score(t, 'tion* <"of the"'), 9).alias("b"), F.round(X.boolean_score(t, "thing ~then"), 9).alias("c"))


@op("fulltext_query_expansion", f"SELECT doc_id, round(len(list_filter({_TOK}, lambda w: w IN ('nation'))) * {X.BASE}::DOUBLE, 9) AS score FROM documents")
def expansion(spark, sf_dir):
    """WITH QUERY EXPANSION counts as natural language."""
    return table(spark, sf_dir, "documents").select("doc_id", F.round(X.natural_score(c("text"), "nation"), 9).alias("score"))


@op("fulltext_relevance_order", f"SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM (SELECT doc_id, round(len(list_filter({_TOK}, lambda w: w IN ('thing', 'then', 'heing', 'nation'))) * {X.BASE}::DOUBLE, 9) AS score FROM documents) t WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20")
def relevance_order(spark, sf_dir):
    """MATCH in WHERE without ORDER BY: the rows that match, most relevant first, ties by key; a report of the first 20."""
    from pyspark.sql.window import Window

    best = X.search(table(spark, sf_dir, "documents"), "doc_id", "text", _QUERY).limit(20)
    return best.select("doc_id", F.round("score", 9).alias("score"), F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).alias("place"))


# -- spatial (2.15) -----------------------------------------------------------------------------------------------
@op("spatial_points", "SELECT s_suppkey AS k, 'POINT(' || s_suppkey || ' ' || s_nationkey || ')' AS p, s_suppkey::DOUBLE AS x, s_nationkey::DOUBLE AS y, round(sqrt(power(s_suppkey - 3, 2) + power(s_nationkey - 4, 2)), 9) AS d, 0 AS srid, 4326 AS srid2, 'POINT' AS kind FROM supplier")
def spatial_points(spark, sf_dir):
    p = G.point(c("s_suppkey"), c("s_nationkey"))
    return table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("k"), p.alias("p"), G.coordinate(p, 0).alias("x"), G.coordinate(p, 1).alias("y"), F.round(G.distance(p, F.lit("POINT(3 4)")), 9).alias("d"), G.srid(p).alias("srid"), G.srid(G.set_srid(p, 4326)).alias("srid2"), G.geometry_type(p).alias("kind"))


@op("spatial_distance_sphere", "SELECT n_nationkey AS k, round(2 * 6370986.0 * asin(sqrt(least(1.0, power(sin((radians(10) - radians(n_nationkey)) / 2), 2) + cos(radians(n_nationkey)) * cos(radians(10)) * power(sin((radians(20) - radians(n_regionkey)) / 2), 2)))), 4) AS d FROM nation")
def spatial_sphere(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(c("n_nationkey").alias("k"), F.round(G.distance_sphere(G.point(c("n_regionkey"), c("n_nationkey")), F.lit("POINT(20 10)")), 4).alias("d"))


_SQUARE = "POLYGON((0 0,10 0,10 10,0 10,0 0))"


@op("spatial_relations_points", "SELECT s_suppkey AS k, s_suppkey < 10 AND s_nationkey > 0 AND s_nationkey < 10 AS inside, s_suppkey <= 10 AND s_nationkey <= 10 AS meets, NOT (s_suppkey <= 10 AND s_nationkey <= 10) AS apart, s_suppkey < 10 AND s_nationkey > 0 AND s_nationkey < 10 AS cont, s_suppkey <= 10 AND s_nationkey <= 10 AND NOT (s_suppkey < 10 AND s_nationkey > 0 AND s_nationkey < 10) AS edge FROM supplier")
def relations_points(spark, sf_dir):
    p, q = G.point(c("s_suppkey"), c("s_nationkey")), F.lit(_SQUARE)
    return table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("k"), G.relation("within", p, q).alias("inside"), G.relation("intersects", p, q).alias("meets"), G.relation("disjoint", p, q).alias("apart"), G.relation("contains", q, p).alias("cont"), G.relation("touches", p, q).alias("edge"))


_BOX = "POLYGON((0 0,4 0,4 4,0 4,0 0))"
_PAIRS = [(_BOX, "POLYGON((2 2,6 2,6 6,2 6,2 2))"), (_BOX, "POLYGON((4 0,8 0,8 4,4 4,4 0))"), ("LINESTRING(-1 1,5 1)", _BOX), ("POLYGON((1 1,2 1,2 2,1 2,1 1))", _BOX), ("LINESTRING(0 0,4 4)", "LINESTRING(0 4,4 0)")]


@op("spatial_relations_shapes", "SELECT * FROM (VALUES (1, true, false, true, false, false), (2, false, true, true, false, false), (3, false, false, true, true, false), (4, false, false, true, false, true), (5, false, false, true, true, false)) t(k, o, t, i, x, w)")
def relations_shapes(spark, sf_dir):
    a, b = c("a"), c("b")
    pairs = spark.createDataFrame([(k, *p) for k, p in enumerate(_PAIRS, 1)], "k int, a string, b string")
    return pairs.select("k", G.relation("overlaps", a, b).alias("o"), G.relation("touches", a, b).alias("t"), G.relation("intersects", a, b).alias("i"), G.relation("crosses", a, b).alias("x"), G.relation("within", a, b).alias("w"))


@op("spatial_mbr", "SELECT s_suppkey AS k, s_suppkey < 10 AND s_nationkey > 0 AND s_nationkey < 10 AS w, s_suppkey <= 10 AND s_nationkey <= 10 AS i, s_suppkey > 10 OR s_nationkey > 10 AS d, s_suppkey <= 10 AND s_nationkey <= 10 AS cb, false AS e FROM supplier")
def mbr(spark, sf_dir):
    p, q = G.point(c("s_suppkey"), c("s_nationkey")), F.lit(_SQUARE)
    return table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("k"), G.mbr_relation("within", p, q).alias("w"), G.mbr_relation("intersects", p, q).alias("i"), G.mbr_relation("disjoint", p, q).alias("d"), G.mbr_relation("coveredby", p, q).alias("cb"), G.mbr_relation("equals", p, q).alias("e"))


@op("spatial_measures", "SELECT 84.0::DOUBLE AS area, 12.0::DOUBLE AS len, 'POINT(5 5)' AS cen, 'POLYGON((0 0,10 0,10 10,0 10,0 0))' AS env, 1 AS holes, 'LINESTRING(2 2,6 2,6 6,2 6,2 2)' AS hole, 3 AS pts, 'POINT(0 0)' AS p1, 'POINT(6 6)' AS pe, 'POINT(6 0)' AS p2, 2 AS dim, 'LINESTRING(0 0,0 6,6 6)' AS swapped, 'LINESTRING(0 0,10 0)' AS simple")
def measures(spark, sf_dir):
    ring = F.lit("POLYGON((0 0,10 0,10 10,0 10,0 0),(2 2,6 2,6 6,2 6,2 2))")
    line = F.lit("LINESTRING(0 0,6 0,6 6)")
    square = F.lit(_SQUARE)
    return spark.range(1).select(
        G.measure("area", ring).alias("area"), G.measure("length", line).alias("len"), G.derive("centroid", square).alias("cen"), G.derive("envelope", ring).alias("env"), G.count_of("numinteriorrings", ring).alias("holes"), G.derive("interiorringn", ring, 1).alias("hole"), G.count_of("numpoints", line).alias("pts"), G.derive("startpoint", line).alias("p1"), G.derive("endpoint", line).alias("pe"), G.derive("pointn", line, 2).alias("p2"), G.count_of("dimension", ring).alias("dim"), G.derive("swapxy", line).alias("swapped"), G.derive("simplify", F.lit("LINESTRING(0 0,5 0.1,10 0)"), 1.0).alias("simple"))


@op("spatial_formats", "SELECT '{\"type\": \"Point\", \"coordinates\": [1, 2]}' AS gj, 'POINT(1 2)' AS back, 'POINT(1 2)' AS wkb, 's00twy01mt' AS gh, 'POLYGON((0 0,4 0,4 4,0 4,0 0))' AS hull, 'POLYGON((4 2,4 4,2 4,2 2,4 2))' AS cut, 'MULTIPOINT((0 0),(1 1))' AS uni, 'POLYGON((0 0,3 0,3 2,0 2,0 0))' AS env, 'GEOMETRYCOLLECTION(POINT(1 2),POINT(3 4))' AS col, 'LINESTRING(1 2,3 4)' AS line")
def formats(spark, sf_dir):
    p = F.lit("POINT(1 2)")
    return spark.range(1).select(
        G.as_geojson(p).alias("gj"), G.geom_from_geojson(G.as_geojson(p)).alias("back"), G.geom_from_wkb(G.as_wkb(p)).alias("wkb"), G.st_geohash(F.lit("POINT(1 1)"), 10).alias("gh"), G.derive("convexhull", F.lit("MULTIPOINT((0 0),(4 0),(4 4),(0 4),(2 2))")).alias("hull"), G.overlay("intersection", F.lit("POLYGON((0 0,4 0,4 4,0 4,0 0))"), F.lit("POLYGON((2 2,6 2,6 6,2 6,2 2))")).alias("cut"), G.overlay("union", F.lit("POINT(0 0)"), F.lit("POINT(1 1)")).alias("uni"), G.make_envelope(F.lit("POINT(0 0)"), F.lit("POINT(3 2)")).alias("env"), G.construct("GEOMETRYCOLLECTION", p, F.lit("POINT(3 4)")).alias("col"), G.construct("LINESTRING", p, F.lit("POINT(3 4)")).alias("line"))


# -- more of 2.5, 2.14, 2.15 ----------------------------------------------------------------------------------------
@op("json_array_arrows", """SELECT n_nationkey AS k, '[' || n_nationkey || ', "' || n_name || '", null]' AS a, '"' || n_name || '"' AS arrow, n_name AS arrow_text FROM nation""")
def array_arrows(spark, sf_dir):
    """JSON_ARRAY, and the operators -> and ->> as extraction and its unquoted text."""
    doc = J.json_object("k", c("n_nationkey"), "name", c("n_name"))
    found = J.json_extract(doc, "$.name")
    return table(spark, sf_dir, "nation").select(c("n_nationkey").alias("k"), J.json_array(c("n_nationkey"), c("n_name"), F.lit(None).cast("string")).alias("a"), found.alias("arrow"), J.json_unquote(found).alias("arrow_text"))


@op("agg_json_array_ordered", "SELECT n_regionkey AS r, '[' || string_agg('\"' || n_name || '\"', ',' ORDER BY n_nationkey DESC) || ']' AS names FROM nation GROUP BY n_regionkey")
def json_array_ordered(spark, sf_dir):
    """JSON_ARRAYAGG over rows in a stated order that isn't that of the values."""
    return table(spark, sf_dir, "nation").groupBy(c("n_regionkey").alias("r")).agg(J.json_arrayagg(c("n_name"), -c("n_nationkey")).alias("names"))


_BOXES = [("POLYGON((0 0,4 0,4 4,0 4,0 0))", "POLYGON((1 1,2 1,2 2,1 2,1 1))"), ("POLYGON((0 0,4 0,4 4,0 4,0 0))", "POLYGON((4 0,8 0,8 4,4 4,4 0))"), ("POLYGON((0 0,4 0,4 4,0 4,0 0))", "POLYGON((2 2,6 2,6 6,2 6,2 2))"), ("POLYGON((0 0,4 0,4 4,0 4,0 0))", "POLYGON((4 4,0 4,0 0,4 0,4 4))")]


@op("spatial_mbr_more", "SELECT * FROM (VALUES (1, true, true, false, false, false), (2, false, false, true, false, false), (3, false, false, false, true, false), (4, true, true, false, false, true)) t(k, contains, covers, touches, overlap, equal)")
def mbr_more(spark, sf_dir):
    """MBRCONTAINS, MBRCOVERS, MBRTOUCHES, MBROVERLAPS, ST_EQUALS."""
    a, b = c("a"), c("b")
    pairs = spark.createDataFrame([(k, *p) for k, p in enumerate(_BOXES, 1)], "k int, a string, b string")
    return pairs.select("k", *(G.mbr_relation(name, a, b).alias(name.rstrip("s") if name == "overlaps" else name) for name in ("contains", "covers", "touches", "overlaps")), G.relation("equals", a, b).alias("equal"))


@op("spatial_point_precision", "SELECT * FROM (VALUES (1.5e-11::DOUBLE, 2.123456789012::DOUBLE), (1e20, -0.1), (3.0, -7.0)) t(x, y)")
def point_precision(spark, sf_dir):
    """Coordinates go through POINT, ST_X and ST_Y unrounded."""
    g = G.point(c("x"), c("y"))
    return spark.createDataFrame([(1.5e-11, 2.123456789012), (1e20, -0.1), (3.0, -7.0)], "x double, y double").select(G.coordinate(g, 0).alias("x"), G.coordinate(g, 1).alias("y"))


@op("spatial_validity", """SELECT * FROM (VALUES ('POLYGON((0 0,4 0,4 4,0 4,0 0))', 1, 'POLYGON((0 0,4 0,4 4,0 4,0 0))'), ('POLYGON((0 0,4 4,4 0,0 4,0 0))', 0, NULL), ('POLYGON((0 0,9 0,9 9,0 9,0 0),(1 1,2 1,2 2,1 1))', 1, 'POLYGON((0 0,9 0,9 9,0 9,0 0),(1 1,2 1,2 2,1 1))'), ('POLYGON((0 0,2 0,2 2,0 0),(5 5,6 5,6 6,5 5))', 0, NULL),
 ('LINESTRING(1 1,1 1)', 0, NULL), ('LINESTRING(0 0,1 1)', 1, 'LINESTRING(0 0,1 1)'), ('POINT(1 2)', 1, 'POINT(1 2)'), ('MULTIPOLYGON(((0 0,4 4,4 0,0 4,0 0)),((0 0,1 0,1 1,0 0)))', 0, NULL), (NULL, NULL, NULL)) t(g, ok, valid)""")
def spatial_validity(spark, sf_dir):
    """ST_ISVALID and ST_VALIDATE."""
    texts = ("POLYGON((0 0,4 0,4 4,0 4,0 0))", "POLYGON((0 0,4 4,4 0,0 4,0 0))", "POLYGON((0 0,9 0,9 9,0 9,0 0),(1 1,2 1,2 2,1 1))", "POLYGON((0 0,2 0,2 2,0 0),(5 5,6 5,6 6,5 5))", "LINESTRING(1 1,1 1)", "LINESTRING(0 0,1 1)", "POINT(1 2)", "MULTIPOLYGON(((0 0,4 4,4 0,0 4,0 0)),((0 0,1 0,1 1,0 0)))")
    shapes = rows(spark, ", ".join(f"('{t}')" for t in texts) + ", (NULL)", "g")
    return shapes.select("g", G.is_valid(c("g")).alias("ok"), G.validate(c("g")).alias("valid"))


@op("spatial_point_setters", "SELECT s_suppkey AS k, 'POINT(7 ' || s_nationkey || ')' AS x7, 'SRID=4326;POINT(' || s_suppkey || ' 0.5)' AS y05, s_suppkey::DOUBLE AS lon, s_nationkey::DOUBLE AS lat, NULL::DOUBLE AS flat FROM supplier")
def spatial_point_setters(spark, sf_dir):
    """ST_X and ST_Y with a value, ST_LONGITUDE and ST_LATITUDE."""
    p = G.point(c("s_suppkey"), c("s_nationkey"))
    globe = G.set_srid(p, 4326)
    return table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("k"), G.with_coordinate(p, 0, F.lit(7)).alias("x7"), G.with_coordinate(globe, 1, F.lit(0.5)).alias("y05"), G.geographic(globe, 0).alias("lon"), G.geographic(globe, 1).alias("lat"), G.geographic(p, 1).alias("flat"))


@op("spatial_collections", """SELECT * FROM (VALUES ('MULTIPOINT(1 1,2 2)', 2, 'POINT(2 2)', 0, NULL, 1), ('GEOMETRYCOLLECTION(POINT(1 1),LINESTRING(0 0,1 1))', 2, 'LINESTRING(0 0,1 1)', 0, NULL, 1), ('LINESTRING(0 0,4 0,4 4,0 0)', 1, NULL, 0, 1, 1), ('LINESTRING(0 0,4 4,4 0,0 4)', 1, NULL, 0, 0, 0), ('GEOMETRYCOLLECTION EMPTY', 0, NULL, 1, NULL, 1)) t(g, n, second, empty, closed, simple)""")
def spatial_collections(spark, sf_dir):
    """ST_NUMGEOMETRIES, ST_GEOMETRYN, ST_ISEMPTY, ST_ISCLOSED, ST_ISSIMPLE."""
    g = c("g")
    shapes = rows(spark, "('MULTIPOINT(1 1,2 2)'), ('GEOMETRYCOLLECTION(POINT(1 1),LINESTRING(0 0,1 1))'), ('LINESTRING(0 0,4 0,4 4,0 0)'), ('LINESTRING(0 0,4 4,4 0,0 4)'), ('GEOMETRYCOLLECTION EMPTY')", "g")
    return shapes.select("g", G.count_of("numgeometries", g).alias("n"), G.derive("geometryn", g, 2).alias("second"), G.count_of("isempty", g).alias("empty"), G.count_of("isclosed", g).alias("closed"), G.count_of("issimple", g).alias("simple"))
