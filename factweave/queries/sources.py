"""Queries of sources and sinks."""

from pyspark.sql import functions as F

from ..sources import html as H
from ..sources import tables as S
from ..streaming.events import scratch
from .registry import Tables, query


@query("SELECT s_nationkey, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier GROUP BY 1")
def s1_pinned_scan(t: Tables):
    manifest = S.stat_artifacts(t.spark, f"{t.sf_dir}/supplier.parquet").withColumn("status", F.lit("done"))
    return S.pinned_scan(t.spark, manifest, ".parquet", t.supplier.schema).groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total"))


@query("SELECT state, 1 AS n FROM (VALUES ('ok'), ('hash differs'), ('missing')) AS v(state)")
def s2_verify_artifacts(t: Tables):
    one = lambda name: S.stat_artifacts(t.spark, f"{t.sf_dir}/{name}.parquet").groupBy().agg(F.min("path").alias("path"), F.min_by("bytes", "path").alias("bytes"), F.min_by("sha256", "path").alias("sha256"))
    manifest = one("orders").unionByName(one("supplier").withColumn("sha256", F.lit("x"))).unionByName(one("nation").withColumn("path", F.concat("path", F.lit(".gone"))))
    found = S.stat_artifacts(t.spark, f"{t.sf_dir}/orders.parquet").unionByName(S.stat_artifacts(t.spark, f"{t.sf_dir}/supplier.parquet"))
    return S.verify_artifacts(manifest, found).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT fact_key, count(*) AS n, round(sum(value_number), 2) AS total FROM facts GROUP BY 1")
def s3_fact_table(t: Tables):
    path = scratch(t.spark, "facts")
    S.write_table(t.facts, path)
    return t.spark.read.parquet(path).groupBy("fact_key").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value_number"), 2).alias("total"))


@query("SELECT 'entities' AS name, count(*) AS n FROM entities UNION ALL SELECT 'edges', count(*) FROM edges")
def s4_tables(t: Tables):
    parts = []
    for name in ("entities", "edges"):
        path = scratch(t.spark, name)
        S.write_table(getattr(t, name), path)
        parts.append(t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n"))
    return parts[0].unionByName(parts[1])


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def s5_snapshot(t: Tables):
    path = S.write_snapshot(t.orders, scratch(t.spark, "snapshots"), "raw", "orders", "1", ["o_orderstatus"])
    return t.spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, count(*) AS n, max(o_orderkey) AS top FROM orders GROUP BY 1")
def s6_fan_in(t: Tables):
    root = scratch(t.spark, "fan-in")
    rows = [("orders", s, v, S.write_snapshot(t.orders.filter(F.col("o_orderstatus") == s).withColumn("v", F.lit(v)), root, s, "orders", str(v)), "done") for s in ("F", "O", "P") for v in (1, 2)]
    manifest = t.spark.createDataFrame(rows, "asset string, partition string, version int, path string, status string")
    return S.fan_in(t.spark, manifest, "orders").filter("v = 2").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("top"))


@query("SELECT c_custkey AS key, c_name AS name FROM customer")
def s7_read_seeds(t: Tables):
    path = scratch(t.spark, "seeds")
    t.customer.groupBy("c_nationkey").agg(F.collect_list(F.struct(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))).alias("seeds")).write.json(path)
    return S.read_seeds(t.spark, path, "seeds array<struct<key: long, name: string>>", "seeds")


@query("SELECT zone_id AS name, 0 AS ring_no, 5 AS points, round(x1, 4) AS east FROM zones")
def s8_read_geojson(t: Tables):
    path = scratch(t.spark, "geojson")
    p = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1"), p("x0", "y0"))
    feature = F.struct(F.struct(F.col("zone_id").alias("name")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    t.zones.groupBy(F.substring("zone_id", -1, 1)).agg(F.collect_list(feature).alias("features")).select("features").write.json(path)
    return S.read_geojson(t.spark, path).select("name", "ring_no", F.size("ring").alias("points"), F.round(F.array_max(F.transform("ring", lambda q: q["x"])), 4).alias("east"))


@query()
def s9_extract_blocks(t: Tables):
    """Paragraph figures; tested against a plain parser on small pages."""
    return S.extract_blocks(t.pages)


@query("SELECT page_id, url, max(score) AS score FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href=\"([^\"]*)\"', 1)) AS url, 2 AS score FROM pages UNION ALL SELECT page_id, unnest(regexp_extract_all(html, '(^|[^\"''=])(https?://[^\\s\"''<>]+)', 2)), 1 FROM pages) GROUP BY ALL")
def s10_extract_links(t: Tables):
    return S.extract_links(t.pages)


@query("SELECT user_id, ts, event_id FROM (SELECT CAST(user_id AS STRING) AS u, user_id, CAST(CAST(ts AS DATE) AS STRING) AS ts, event_id FROM events) WHERE contains(u, '99')")
def s12_preview(t: Tables):
    rows = t.events.select("user_id", F.to_date("ts").cast("string").alias("ts"), "event_id")
    return S.preview(rows, ["user_id", "ts", "event_id"], "user_id", "99", "contains")


@query("SELECT page_id, row - 1 AS row, trim(regexp_replace(item, '<[^>]*>', '', 'g')) AS label, regexp_extract(item, 'href=\"([^\"]*)\"', 1) AS link FROM (SELECT page_id, unnest(l) AS item, generate_subscripts(l, 1) AS row FROM (SELECT page_id, regexp_extract_all(html, '(?is)<li>(.*?)</li>', 1) AS l FROM pages)) WHERE link <> ''")
def s13_extract_rows(t: Tables):
    return S.extract_rows(t.pages).withColumn("row", F.col("row").cast("long"))


_LINES = {"status": ["Status"], "line": ["Line No."], "quantity": ["Qty", "Quantity"], "document": ["Document"]}


def _order_pages(t: Tables):
    """A page an order with its lines as a table, the way that real pages have them: a status that spans rows of equal flag, cells and rows left open, an inner table, a note."""
    cells = F.concat(F.lit("<td>"), "l_linenumber", F.lit("</td><td>"), F.col("l_quantity").cast("int"), F.lit("<table><tr><td>inner</table></td><TD><a href='/s?id="), "l_suppkey", F.lit("&amp;mode="), "l_linestatus", F.lit("'>Supplier&nbsp;"), "l_suppkey", F.lit("</a>"))
    line = F.struct("l_linenumber", "l_quantity", "l_linestatus", "l_suppkey", cells.alias("cells"))
    # dealt by the order once; the lines of a flag, then the flags of an order, are gathered where they are: at most seven lines
    flags = t.lineitem.repartition("l_orderkey").groupBy("l_orderkey", "l_returnflag").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    status = F.concat(F.lit("<tr><td rowspan='"), F.size("lines"), F.lit("'> <b>"), "l_returnflag", F.lit("</b>"))
    part = F.struct("l_returnflag", F.concat(status, F.array_join("lines.cells", "<tr>")).alias("rows"))
    orders = flags.groupBy(F.col("l_orderkey").alias("page_id")).agg(F.sort_array(F.collect_list(part)).alias("parts"), F.sum(F.size("lines")).alias("n"), F.sum(F.when(F.col("l_returnflag") == "R", F.size("lines")).otherwise(0)).alias("returned"))

    detail = F.concat(F.lit("<table><tr><th>Lines</th><td>"), "n", F.lit("</td><td>Returned:</td><td>"), "returned", F.lit("</td></tr><tr><th colspan=2>Order<td>no. "), "page_id", F.lit("</table>"))
    head = F.lit("<html><script>var x = '<table><tr><td>';</script><!-- <table> --><table id=\"lines\"><thead><tr><th>Status<th>LINE no<th>Quantity<th>Document</thead><tbody>")
    return orders.select("page_id", F.concat(head, F.array_join("parts.rows", ""), F.lit("<tr><td colspan=3>note</table></p></td>"), detail).alias("html"))


@query("SELECT l_orderkey AS page_id, l_returnflag AS status, CAST(l_linenumber AS VARCHAR) AS line, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS quantity, concat('Supplier ', l_suppkey) AS document, concat('/s?id=', l_suppkey, '&mode=', l_linestatus) AS document_link FROM lineitem")
def s13_table_records(t: Tables):
    """Records of tables with row spans, open tags and inner tables, by configured column labels."""
    return H.grid_records(H.table_grids(_order_pages(t)), _LINES).select("page_id", "status", "line", "quantity", "document", "document_link")


@query("SELECT l_orderkey AS page_id, unnest(['Lines', 'Returned', 'Order']) AS label, unnest([CAST(count(*) AS VARCHAR), CAST(count(*) FILTER (l_returnflag = 'R') AS VARCHAR), concat('no. ', l_orderkey)]) AS value FROM lineitem GROUP BY l_orderkey")
def s16_table_fields(t: Tables):
    """Label and value rows of detail tables: several pairs a row, labels that span columns."""
    return H.grid_fields(H.table_grids(_order_pages(t)).filter("table_id IS NULL")).select("page_id", "label", "value")


@query("SELECT concat('station ', s_suppkey % 50) AS name, round(12.8 + (s_suppkey % 50) * 0.01::DOUBLE, 5) AS y, max(s_suppkey) AS id FROM supplier GROUP BY s_suppkey % 50")
def s14_read_elements(t: Tables):
    path = scratch(t.spark, "elements")
    k = F.col("s_suppkey")
    tags = F.map_from_arrays(F.concat(F.array(F.lit("name")), F.transform(F.sequence(F.lit(0), (k / 50).cast("int")), lambda i: F.concat(F.lit("t"), i))), F.concat(F.array(F.concat(F.lit("station "), k % 50)), F.transform(F.sequence(F.lit(0), (k / 50).cast("int")), lambda i: F.lit("v"))))
    e = F.struct(F.lit("node").alias("type"), k.alias("id"), (F.lit(12.8) + (k % 50) * 0.01).alias("lat"), F.lit(77.5).alias("lon"), tags.alias("tags"))
    t.supplier.groupBy("s_nationkey").agg(F.collect_list(e).alias("elements")).select("elements").write.json(path)
    return S.read_elements(t.spark, path).select("name", "y", "id")


@query("SELECT zone_id AS name, 4 AS points, round(x0 + x1 + x1 + x0, 4) AS xs FROM zones")
def s15_read_kml(t: Tables):
    path = scratch(t.spark, "kml")
    ring = F.concat_ws(" ", *[F.concat_ws(",", x, y) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))])
    text = F.concat(F.lit("<Placemark><name>"), "zone_id", F.lit("</name><Polygon><outerBoundaryIs><LinearRing><coordinates>"), ring, F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"))
    t.zones.agg(F.concat(F.lit("<kml>\n"), F.array_join(F.collect_list(text), "\n"), F.lit("\n</kml>")).alias("value")).write.text(path)
    return S.read_kml(t.spark, path).select("name", F.size("ring").alias("points"), F.round(F.aggregate("ring", F.lit(0.0), lambda s, p: s + p["x"]), 4).alias("xs"))


@query("SELECT page_id, label, value FROM (SELECT page_id, 'lang' AS label, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS value FROM pages UNION ALL SELECT page_id, 'title', regexp_extract(html, '(?is)<title>(.*?)</title>', 1) FROM pages UNION ALL SELECT page_id, 'heading', regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1) FROM pages) WHERE value <> ''")
def s16_extract_fields(t: Tables):
    return S.extract_fields(t.pages)
