"""The first query end to end: unpivoted facts, resolved by trust, made wide, added up by owner."""

from pyspark.sql import functions as F

from ..operators import windows as W
from .registry import Tables, query

_BEST = "SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY entity_id, fact_key ORDER BY CASE source_type WHEN 'registry' THEN 0 WHEN 'portal' THEN 1 WHEN 'review' THEN 2 WHEN 'forum' THEN 3 ELSE 4 END, least(confidence, 0.9) DESC, confidence DESC, value_text DESC, fact_no DESC) = 1"


@query(f"""WITH b AS ({_BEST}), w AS (SELECT entity_id, max(value_number) FILTER (fact_key = 'order_total') AS total, max(value_text) FILTER (fact_key = 'order_status') AS status FROM b GROUP BY 1)
    SELECT dst AS nation, status, count(*) AS customers, round(sum(total), 2) AS total FROM w JOIN edges ON src = entity_id AND edge_type = 'located_in' GROUP BY ALL""")
def flagship(t: Tables):
    best = W.resolve_facts(t.facts, {"registry": 0, "portal": 1, "review": 2, "forum": 3})
    wide = best.groupBy("entity_id").pivot("fact_key", ["order_total", "order_status"]).agg(F.first("value_number").alias("n"), F.first("value_text").alias("t"))
    placed = t.edges.filter("edge_type = 'located_in'").select(F.col("src").alias("entity_id"), F.col("dst").alias("nation"))
    return wide.join(placed, "entity_id").groupBy("nation", F.col("order_status_t").alias("status")).agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("order_total_n"), 2).alias("total"))
