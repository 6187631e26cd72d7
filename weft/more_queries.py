"""Queries over the rest of the inventory; imported by weft.queries, which they share their helpers with."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import predicates as P
from weft.functions import scalars as S
from weft.operators import aggregate as A
from weft.operators import analytics as N
from weft.operators import hyper as H
from weft.operators import match as M
from weft.operators import reify as R
from weft.operators import scan as C
from weft.operators import temporal as T
from weft.operators import text as X
from weft.operators import traverse as V
from weft.plans import triples as Q
from weft.plans.builder import GraphQuery, Script
from weft.plans.datalog import Program
from weft.plans.language import Knowledge
from weft.plans.lineage import broadcast_if_small, shared_path, table
from weft.plans.store import Store
from weft.queries import BOTH, FACTS, TRIPLES, _META, _meta, _NODES, _orders_as_edges, _relaxed, _UW, one, part_graph, part_pairs, parts, supplier_graph, suppliers
from weft.registry import query
from weft.sources import formats
from weft.sources import tables as G
from weft.streaming import events as W

LONG = lambda x: F.lit(x).cast("long")

# Changes, stores and formats.


@query("SELECT 'r:' || o_orderkey AS id, 'PLACED' AS original_type FROM orders WHERE o_totalprice >= 450000")
def batch_reified(spark: SparkSession, d: str) -> DataFrame:
    """Large orders reified in a batch; ids that no order has fail alone."""
    ids = G.read(spark, d, "orders").filter("o_totalprice >= 450000").select(F.col("o_orderkey").alias("id")).unionByName(spark.createDataFrame([(-1,)], "id long"))
    return R.reify_valid(_orders_as_edges(spark, d), ids)[0][0].select("id", "original_type")


@query("SELECT 'r:' || o_orderkey AS id, CASE WHEN o_totalprice >= 450000 THEN 0.0 ELSE o_totalprice END AS price FROM orders WHERE o_totalprice >= 100000")
def batch_update_reified(spark: SparkSession, d: str) -> DataFrame:
    """Reified orders changed and deleted in one batch."""
    nodes = R.reify(_orders_as_edges(spark, d))[0].select("id", "price")
    changes = nodes.filter("price >= 450000").select("id", F.lit(0.0).alias("price"), F.lit("update").alias("op"))
    gone = nodes.filter("price < 100000").select("id", "price", F.lit("delete").alias("op"))
    return C.apply_changes(nodes, table(changes.unionByName(gone), "changes"))


@query("""
WITH b AS (SELECT DISTINCT l_orderkey AS hid, l_partkey AS node FROM lineitem), g AS (SELECT hid, count(*) FILTER (WHERE node NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)) AS missing FROM b GROUP BY 1)
SELECT hid, missing::BIGINT AS missing FROM g WHERE missing > 0""")
def refused_hyperedges(spark: SparkSession, d: str) -> DataFrame:
    """Orders that can't be made, as some of their parts are no nodes."""
    return H.create(G.baskets(spark, d), G.read(spark, d, "part").filter("p_size > 5").select(F.col("p_partkey").alias("id")))[1]


@query("SELECT (SELECT count(*) FROM nation) + 1 AS nodes, (SELECT count(*) FROM nation) + 1 AS edges, 1 AS version")
def transaction_commit(spark: SparkSession, d: str) -> DataFrame:
    """One transaction commits a node and an edge, another is rolled back, a third comes too late."""
    store = Store(G.Graph(G.nodes(spark, d, "Nation", "Region").select("id", "type"), G.edges(spark, d, "IN_REGION").select("src", "dst", "type")))
    late = store.begin().delete(one(spark, "N1").withColumnRenamed("node", "id"))
    store.begin().insert(nodes=one(spark, "X").withColumnRenamed("node", "id").withColumn("type", F.lit("Nation"))).rollback()
    new = spark.createDataFrame([("N99", "Nation")], "id string, type string"), spark.createDataFrame([("N99", "R0", "IN_REGION")], "src string, dst string, type string")
    version = store.begin().insert(*new).commit()
    try:
        late.commit()
    except ValueError:
        version += 0
    counts = A.count_graph(store.graph).select((F.col("nodes") - 5).alias("nodes"), "edges")
    return counts.withColumn("version", F.lit(version))


@query(f"WITH {TRIPLES} SELECT s, p, o FROM t")
def import_turtle(spark: SparkSession, d: str) -> DataFrame:
    """Triples written as Turtle, gathered to documents by their first letter, and read again."""
    lines = formats.turtle_lines(G.triples(spark, d))
    documents = lines.groupBy(F.substring("line", 1, 12).alias("k")).agg(F.array_join(F.collect_list("line"), "\n").alias("text"))
    return formats.read_turtle(documents)


@query("SELECT 'N' || n_nationkey AS id, n_regionkey::VARCHAR AS region, 'R' || n_regionkey AS dst FROM nation")
def json_graph_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A whole graph as JSON lines, and read again."""
    path = shared_path(spark, "graph")
    formats.write(G.edges(spark, d, "IN_REGION"), path, "jsonl", nodes=G.nodes(spark, d, "Nation"))
    nodes, edges = formats.load_graph(spark, path)
    return nodes.join(edges, F.col("id") == F.col("src")).select("id", F.col("properties")["n_regionkey"].alias("region"), "dst")


@query("""SELECT '{"subject":"R' || r_regionkey || '","facts":{"name":["' || r_name || '"]}}' AS line FROM region UNION ALL SELECT '{"subject":"N' || n_nationkey || '","facts":{"name":["' || n_name || '"],"regionkey":["R' || n_regionkey || '"]}}' FROM nation""")
def export_facts_json(spark: SparkSession, d: str) -> DataFrame:
    return formats.facts_json(G.triples(spark, d).filter(F.col("s").rlike("^[RN]")))


@query("""SELECT '<node id="N' || n_nationkey || '"><data key="type">Nation</data><data key="n_regionkey">' || n_regionkey || '</data></node>' AS line FROM nation
UNION ALL SELECT '<edge source="N' || n_nationkey || '" target="R' || n_regionkey || '"><data key="type">IN_REGION</data></edge>' FROM nation
UNION ALL SELECT unnest(['<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="type" for="all" attr.name="type" attr.type="string"/><graph edgedefault="directed">', '</graph></graphml>'])""")
def export_graphml_document(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with properties, edges, and the frame."""
    return formats.document(G.nodes(spark, d, "Nation"), G.edges(spark, d, "IN_REGION"), "graphml")


@query("""SELECT '<node id="N' || n_nationkey || '" label="Nation"><attvalues><attvalue for="n_regionkey" value="' || n_regionkey || '"/></attvalues></node>' AS line FROM nation
UNION ALL SELECT '<edge source="N' || n_nationkey || '" target="R' || n_regionkey || '" weight="1.0"/>' FROM nation
UNION ALL SELECT unnest(['<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="directed">', '<nodes>', '</nodes><edges>', '</edges>', '</graph></gexf>'])""")
def export_gexf_document(spark: SparkSession, d: str) -> DataFrame:
    return formats.document(G.nodes(spark, d, "Nation"), G.edges(spark, d, "IN_REGION"), "gexf")


@query("""SELECT '  "N' || n_nationkey || '" [type="Nation", "n_regionkey"="' || n_regionkey || '"];' AS line FROM nation""")
def export_dot_nodes(spark: SparkSession, d: str) -> DataFrame:
    return formats.dot_nodes(G.nodes(spark, d, "Nation"))


@query("""SELECT 'CREATE (:Nation {id: "N' || n_nationkey || '", n_regionkey: "' || n_regionkey || '"});' AS line FROM nation""")
def export_cypher_nodes(spark: SparkSession, d: str) -> DataFrame:
    return formats.cypher_nodes(G.nodes(spark, d, "Nation"))


@query("""SELECT '"C' || o_custkey || '","O' || o_orderkey || '","PLACED",' || CASE WHEN o_totalprice = floor(o_totalprice) THEN o_totalprice::BIGINT || '.0' ELSE o_totalprice::VARCHAR END AS line FROM orders WHERE o_totalprice >= 450000""")
def export_bulk_edges(spark: SparkSession, d: str) -> DataFrame:
    """Lines that graph databases load in bulk."""
    return formats.bulk_edges(G.edges(spark, d, "PLACED").filter("weight >= 450000"))


@query("""SELECT 'HSET node:N' || n_nationkey || ' type "Nation" n_regionkey "' || n_regionkey || '"' AS line FROM nation""")
def export_key_values(spark: SparkSession, d: str) -> DataFrame:
    return formats.key_value_commands(G.nodes(spark, d, "Nation"))


@query("""
WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem) SELECT src, (sum(count(*)) OVER (ORDER BY src) - count(*))::BIGINT AS first, count(*)::BIGINT AS degree, list_sort(list(dst)) AS targets FROM e GROUP BY src""")
def compressed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' parts as compressed rows, written and read again."""
    e = G.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return table(G.adjacency(e), "rows")


@query("SELECT count(*)::BIGINT AS n, sum(o_totalprice) > 0 AS any FROM orders")
def compacted(spark: SparkSession, d: str) -> DataFrame:
    """Many small files as two, with the same rows."""
    path, to = shared_path(spark, "many"), shared_path(spark, "few")
    G.read(spark, d, "orders").repartition(16).write.parquet(path)
    formats.compact(spark, path, to, 2)
    return spark.read.parquet(to).agg(F.count("*").alias("n"), (F.sum("o_totalprice") > 0).alias("any"))


_PLACES = "('0x' || substr(md5({}), 1, 8))::BIGINT % 8"


@query("""
WITH e AS (SELECT DISTINCT 'S' || s_suppkey AS src, 'N' || s_nationkey AS dst FROM supplier), h AS (SELECT 'hash' AS how, {0} AS shard FROM e UNION ALL SELECT 'vertex-cut', {1} FROM e
UNION ALL SELECT 'edge-cut', {0} FROM e UNION ALL SELECT 'edge-cut', {2} FROM e WHERE {0} <> {2} UNION ALL SELECT 'range', CASE WHEN src >= 'S5' THEN 1 ELSE 0 END FROM e)
SELECT how, shard, count(*)::BIGINT AS n FROM h GROUP BY 1, 2""".format(_PLACES.format("src"), _PLACES.format("src || '|' || dst"), _PLACES.format("dst")))
def edge_shards(spark: SparkSession, d: str) -> DataFrame:
    """Edges by shard, for each way to deal them."""
    e = G.edges(spark, d, "LOCATED_IN").filter(F.col("src").startswith("S")).select("src", "dst").distinct()
    out = None
    for how in ("hash", "vertex-cut", "edge-cut", "range"):
        dealt = G.partitioned(e, how, 8, ["S5"]).groupBy("shard").agg(F.count("*").alias("n")).select(F.lit(how).alias("how"), "shard", "n")
        out = dealt if out is None else out.unionByName(dealt)
    return out


# Filters, joins, aggregates, pages.


@query("""
WITH e AS (SELECT 'C' || c_custkey AS src, 'N' || c_nationkey AS mid, 'R' || n_regionkey AS dst FROM customer JOIN nation ON n_nationkey = c_nationkey) SELECT src AS node, 2 AS length FROM e""")
def path_length_constraint(spark: SparkSession, d: str) -> DataFrame:
    """Ways up from customers that are exactly two edges long."""
    e = G.edges(spark, d, "LOCATED_IN", "IN_REGION")
    up = e.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(e.select(F.col("src").alias("b"), F.col("dst").alias("c")), "b", "left")
    paths = up.filter(F.col("a").startswith("C")).select(F.array_compact(F.array("a", "b", "c")).alias("path"))
    return paths.filter(P.path_constraint(least=2, most=2)).select(F.col("path")[0].alias("node"), (F.size("path") - 1).alias("length"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderdate > TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND o_totalprice BETWEEN 100000 AND 400000")
def filter_inputs(spark: SparkSession, d: str) -> DataFrame:
    rows = G.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("type"), F.col("o_orderdate").alias("created"), F.col("o_totalprice").alias("weight"))
    return rows.filter(P.filter_input(types=["F", "O"], created_after=dt.datetime(1995, 1, 1), created_before=dt.datetime(1998, 1, 1), weight_min=100000.0, weight_max=400000.0)).select("id")


@query("SELECT l_suppkey AS s, l_partkey AS p, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 3 AND sum(l_quantity) <= 60")
def filtered_matches(spark: SparkSession, d: str) -> DataFrame:
    pairs = G.read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return M.filtered(pairs, n=(2, 3), q=(None, 60)).select("s", "p", "n")


@query("SELECT o_orderkey, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def checked_join(spark: SparkSession, d: str) -> DataFrame:
    """Small sides are broadcast after a check of their size, others shuffled."""
    c = G.read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    n = G.read(spark, d, "nation").select("n_nationkey", "n_name")
    return G.read(spark, d, "orders").join(broadcast_if_small(c), "o_custkey").join(broadcast_if_small(n), "n_nationkey").select("o_orderkey", "n_name")


@query("SELECT avg(k) AS mean_size, count(*)::BIGINT AS hyperedges FROM (SELECT count(DISTINCT l_partkey) AS k FROM lineitem GROUP BY l_orderkey)")
def hyper_mean_size(spark: SparkSession, d: str) -> DataFrame:
    return H.mean_size(G.baskets(spark, d))


@query("""
SELECT c_custkey, round((CASE WHEN c_acctbal >= 0 THEN 3 ELSE 2 END / 3.0 + (1 + (c_mktsegment = 'BUILDING')::INT) / CASE WHEN c_acctbal >= 0 THEN 3.0 ELSE 2.0 END) / 2, 9) AS similarity FROM customer""")
def binding_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Likeness of each customer's bindings to those of a given match."""
    c = G.read(spark, d, "customer")
    own = F.map_concat(F.create_map(F.lit("kind"), F.lit("C"), F.lit("segment"), F.col("c_mktsegment")), F.when(F.col("c_acctbal") >= 0, F.create_map(F.lit("rich"), F.lit("yes"))).otherwise(F.create_map().cast("map<string,string>")))
    given = F.create_map(F.lit("kind"), F.lit("C"), F.lit("segment"), F.lit("BUILDING"), F.lit("rich"), F.lit("no"))
    return c.select("c_custkey", F.round(M.binding_similarity(own, given), 9).alias("similarity"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY n DESC NULLS LAST, c_custkey)::BIGINT AS nth FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice >= 300000 GROUP BY 1) ON o_custkey = c_custkey")
def sorted_nulls_last(spark: SparkSession, d: str) -> DataFrame:
    """Customers by the number of large orders; those without any come last."""
    n = G.read(spark, d, "orders").filter("o_totalprice >= 300000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = G.read(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left")
    return A.numbered(rows, [F.col("n").desc_nulls_last(), F.asc("c_custkey")]).select("c_custkey", "nth")


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders)::BIGINT AS total_count, true AS has_next FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 10")
def cursor_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page, from the cursor of the first one's last row."""
    o = G.read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    last = M.connection(o, "o_totalprice", "o_orderkey", 10).orderBy("o_totalprice", F.desc("o_orderkey")).first()
    return M.connection(o, "o_totalprice", "o_orderkey", 10, M.cursor_of(last["o_totalprice"], last["o_orderkey"]))


# Patterns and traversals.


@query("SELECT 'C' || o_custkey AS c, 'O' || o_orderkey AS o FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE coalesce(n, 0) <= 1")
def pattern_degree_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Orders with at most one line: a bound that nodes without edges meet."""
    pattern = M.Pattern([M.NodeSpec("o", max_degree=1, direction="out")], [M.EdgeSpec("c", "o", "PLACED")])
    return M.match(G.edges(spark, d, "PLACED", "CONTAINS"), pattern).select("c", "o")


@query("SELECT 'N' || n_nationkey AS n, 'R' || r_regionkey AS r FROM nation, region WHERE n_regionkey = 1")
def pattern_nodes_only(spark: SparkSession, d: str) -> DataFrame:
    """Two nodes without an edge between them that is asked for."""
    pattern = M.Pattern([M.NodeSpec("n", (F.col("type") == "Nation") & (P.prop("n_regionkey") == "1")), M.NodeSpec("r", F.col("type") == "Region")])
    return M.match(G.edges(spark, d, "IN_REGION"), pattern, G.nodes(spark, d, "Nation", "Region"))


@query(f"WITH {FACTS} SELECT subject AS c, object AS o FROM f WHERE valid_from <= TIMESTAMP '1997-06-01' AND (valid_to IS NULL OR valid_to >= TIMESTAMP '1997-06-01') AND confidence >= 0.9")
def pattern_temporal(spark: SparkSession, d: str) -> DataFrame:
    """An edge that must hold at a time with some confidence."""
    e = G.facts(spark, d).select(F.col("subject").alias("src"), F.col("object").alias("dst"), F.lit("HAS").alias("type"), F.lit(1.0).alias("weight"), "valid_from", "valid_to", "confidence")
    return M.match(e, M.Pattern([], [M.EdgeSpec("c", "o", "HAS", valid_at="1997-06-01 00:00:00", min_confidence=0.9)])).select("c", "o")


@query(f"""
WITH {parts()}, {BOTH}, k AS (SELECT src AS v, count(*) AS d FROM u GROUP BY 1), t AS MATERIALIZED (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst),
tv AS (SELECT v, count(*) AS t FROM (SELECT unnest([a, b, c]) AS v FROM t) GROUP BY 1), te AS (SELECT p, q, count(*) AS t FROM (SELECT a AS p, b AS q FROM t UNION ALL SELECT a, c FROM t UNION ALL SELECT b, c FROM t) GROUP BY 1, 2),
w AS (SELECT x.dst AS p, y.dst AS q, count(*) AS n FROM u x JOIN u y ON x.src = y.src AND x.dst < y.dst GROUP BY 1, 2),
s AS (SELECT (SELECT count(*) FROM t) AS t, (SELECT sum(d * (d - 1) * (d - 2) / 6) FROM k) AS stars, (SELECT sum((a.d - 1) * (z.d - 1)) FROM e JOIN k a ON a.v = e.src JOIN k z ON z.v = e.dst) AS paths,
  (SELECT sum(tv.t * (k.d - 2)) FROM tv JOIN k ON k.v = tv.v) AS paws, (SELECT sum(t * (t - 1) / 2) FROM te) AS diamonds, (SELECT sum(n * (n - 1) / 2) / 2 FROM w) AS cycles,
  (SELECT count(*) FROM t x JOIN t y ON x.a = y.a AND x.b = y.b AND x.c < y.c JOIN e ON e.src = x.c AND e.dst = y.c) AS k4),
r1 AS (SELECT *, diamonds - 6 * k4 AS diamond FROM s), r2 AS (SELECT *, cycles - diamond - 3 * k4 AS cycle, paws - 4 * diamond - 12 * k4 AS paw FROM r1)
SELECT 'clique' AS kind, k4::BIGINT AS n FROM r2 UNION ALL SELECT 'diamond', diamond::BIGINT FROM r2 UNION ALL SELECT 'cycle', cycle::BIGINT FROM r2 UNION ALL SELECT 'paw', paw::BIGINT FROM r2
UNION ALL SELECT 'star', (stars - paw - 2 * diamond - 4 * k4)::BIGINT FROM r2 UNION ALL SELECT 'path', (paths - 3 * t - 4 * cycle - 2 * paw - 6 * diamond - 12 * k4)::BIGINT FROM r2""")
def motif_counts_4(spark: SparkSession, d: str) -> DataFrame:
    return M.motifs(part_pairs(spark, d), 4)


@query("SELECT true AS same, false AS other")
def isomorphic_graphs(spark: SparkSession, d: str) -> DataFrame:
    """The places of nations in regions, renamed, are the same graph; with an edge elsewhere they are not."""
    e = G.edges(spark, d, "IN_REGION").select("src", "dst")
    renamed = e.select(F.concat(F.lit("x"), F.reverse("src")).alias("dst"), F.concat(F.lit("y"), "dst").alias("src"))
    moved = renamed.filter("dst <> 'x1N'").unionByName(spark.createDataFrame([("x1N", "x2N")], "dst string, src string"))
    return spark.range(1).select(F.lit(M.isomorphic(e, renamed)).alias("same"), F.lit(M.isomorphic(e, moved)).alias("other"))


@query("SELECT 'N' || s_nationkey AS n, count(*)::BIGINT AS sellers, round(count(*) / (25 + 5 + (SELECT count(*) FROM supplier) - 1)::DOUBLE + 1 / (25 + 5 + (SELECT count(*) FROM supplier) - 1)::DOUBLE, 9) AS centrality FROM supplier GROUP BY 1")
def complex_query(spark: SparkSession, d: str) -> DataFrame:
    """A pattern, grouped, with a centrality over the whole graph: nations by sellers and degree."""
    e = G.edges(spark, d, "LOCATED_IN", "IN_REGION").filter(~F.col("src").startswith("C"))
    q = GraphQuery(G.Graph(G.nodes(spark, d, "Nation"), e))
    return q.match(("s", "LOCATED_IN", "n"), ("n", "IN_REGION", "r")).group("n", sellers=F.count("*")).central("n", "degree").rows.withColumn("centrality", F.round("centrality", 9))


@query("SELECT c_custkey, count(*)::BIGINT AS n FROM events JOIN customer ON c_custkey = user_id WHERE event_type = 'purchase' AND value >= 50 GROUP BY 1")
def stream_live_matches(spark: SparkSession, d: str) -> DataFrame:
    """Purchases as they come in, with the customers that they belong to."""
    source = shared_path(spark, "live")
    G.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(source)
    nodes = G.read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    got = W.live_matches(W.stream(spark, source, files_per_trigger=2), nodes, "user_id", (F.col("event_type") == "purchase") & (F.col("value") >= 50))
    rows = W.run_to_memory(got.select("user_id"), "live_" + source.rsplit("-", 1)[1], "append", shared_path(spark, "live-state"))
    return rows.groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("n"))


@query("""
WITH RECURSIVE e AS (SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst FROM nation UNION SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier),
r AS (SELECT 'R1' AS node, 0 AS depth, ['R1'] AS k UNION ALL SELECT e.dst, r.depth + 1, list_append(r.k, e.dst) FROM r JOIN e ON e.src = r.node) SELECT node, depth::BIGINT AS depth, (row_number() OVER (ORDER BY k) - 1)::BIGINT AS nth FROM r""")
def dfs_order(spark: SparkSession, d: str) -> DataFrame:
    """Below a region, branch by branch."""
    e = G.edges(spark, d, "IN_REGION", "LOCATED_IN").filter(~F.col("src").startswith("C")).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return V.dispatch(e, "R1", "dfs", 10)


@query("SELECT 'N' || n_nationkey AS node, 1 AS depth, ['R1', 'N' || n_nationkey] AS path FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'S' || s_suppkey, 2, ['R1', 'N' || n_nationkey, 'S' || s_suppkey] FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 1")
def khop_paths(spark: SparkSession, d: str) -> DataFrame:
    e = G.edges(spark, d, "IN_REGION", "LOCATED_IN").filter(~F.col("src").startswith("C"))
    return V.k_hop(e, "R1", 2, "in", paths=True)


@query("SELECT 'N' || c_nationkey AS node, 1 AS depth FROM customer WHERE c_custkey = 1 UNION ALL SELECT 'R' || n_regionkey, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 1")
def typed_hops(spark: SparkSession, d: str) -> DataFrame:
    """Up to three edges of some types from a customer."""
    return V.k_hop(G.edges(spark, d, "LOCATED_IN", "IN_REGION", "PLACED"), "C1", 3, kinds=["LOCATED_IN", "IN_REGION"])


@query("SELECT node, depth FROM (SELECT 'C1' AS node, 0 AS depth UNION ALL SELECT 'O' || o_orderkey, 1 FROM orders WHERE o_custkey = 1 UNION ALL SELECT 'N' || c_nationkey, 1 FROM customer WHERE c_custkey = 1) ORDER BY depth, node LIMIT 3")
def bfs_max_results(spark: SparkSession, d: str) -> DataFrame:
    return V.bfs(G.edges(spark, d, "PLACED", "LOCATED_IN"), one(spark, "C1"), 1, max_results=3)


@query(f"WITH {suppliers()}, {_UW}, {_relaxed('uw', 'SELECT 1::BIGINT AS node', 6)} SELECT distance FROM r6 WHERE node = 9")
def a_star_distance(spark: SparkSession, d: str) -> DataFrame:
    """With the lightest edge at each node as what is left at least."""
    e = supplier_graph(spark, d)
    near = e.select(F.explode(F.array("src", "dst")).alias("node"), "weight").groupBy("node").agg(F.min("weight").alias("h")).withColumn("h", F.when(F.col("node") == 9, 0.0).otherwise(F.col("h")))
    return V.a_star(e, LONG(1), LONG(9), near, "both").select("distance")


@query("""
WITH RECURSIVE e AS (SELECT 'N' || n_nationkey AS src, 'R' || n_regionkey AS dst FROM nation), u AS (SELECT * FROM e UNION SELECT dst, src FROM e), v AS (SELECT DISTINCT src AS node FROM u),
p AS (SELECT node AS source, node, 0 AS distance FROM v UNION SELECT p.source, u.dst, p.distance + 1 FROM p JOIN u ON u.src = p.node WHERE p.distance < 2) SELECT source, node, min(distance)::INT AS distance FROM p GROUP BY 1, 2""")
def all_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All nations and regions from each other."""
    e = G.edges(spark, d, "IN_REGION")
    return V.multi_bfs(e, N.vertices(e), None, "both").withColumnRenamed("depth", "distance")


@query("SELECT false AS above, true AS around")
def cycle_test(spark: SparkSession, d: str) -> DataFrame:
    """Places lead up only; with a way back there is a cycle."""
    e = G.edges(spark, d, "LOCATED_IN", "IN_REGION").select("src", "dst")
    back = e.unionByName(spark.createDataFrame([("R1", "C1")], "src string, dst string")) if e.filter("src = 'C1'").isEmpty() else e.unionByName(e.filter("src = 'C1'").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return spark.range(1).select(F.lit(V.topological_layers(e)[1]).alias("above"), F.lit(V.topological_layers(back)[1]).alias("around"))


@query(f"WITH {suppliers()}, {_UW}, w AS (SELECT src, dst, 1 / weight AS weight FROM uw), {_relaxed('w', 'SELECT 7::BIGINT AS node', 6)} SELECT node, round(distance, 9) AS distance FROM r6")
def custom_weight(spark: SparkSession, d: str) -> DataFrame:
    """Distances by a weight of one's own: the more orders two suppliers share, the nearer they are."""
    found = V.shortest_distances(supplier_graph(spark, d), one(spark, 7).select(F.col("node").cast("long")), "both", 6, weight=1 / F.col("weight"))
    return found.select("node", F.round("distance", 9).alias("distance"))


# Analytics.


def _rank_sql(rounds: int) -> str:
    out = ["x0 AS (SELECT node, 1.0 / (SELECT count(*) FROM v) AS r FROM v)"]
    for k in range(1, rounds + 1):
        out.append(f"x{k} AS MATERIALIZED (SELECT v.node, 0.15 / (SELECT count(*) FROM v) + 0.85 * coalesce(g.g, 0) AS r FROM v LEFT JOIN (SELECT u.dst AS node, sum(x{k - 1}.r / k.n) AS g FROM u JOIN k ON k.src = u.src JOIN x{k - 1} ON x{k - 1}.node = u.src GROUP BY 1) g ON g.node = v.node)")
    return ", ".join(out)


@query(f"WITH {parts()}, {BOTH}, {_NODES}, k AS (SELECT src, count(*) AS n FROM u GROUP BY 1), {_rank_sql(40)} SELECT node, round(r, 7) AS rank FROM x40")
def pagerank_until_still(spark: SparkSession, d: str) -> DataFrame:
    """Until no rank changes by more than a billionth."""
    return N.pagerank(C.both_ways(part_graph(spark, d)), tolerance=1e-9, change="max").withColumn("rank", F.round("rank", 7))


@query(f"WITH {suppliers()}, {_UW}, {_relaxed('uw', 'SELECT 7::BIGINT AS node', 6)} SELECT max(distance) AS eccentricity FROM r6")
def weighted_eccentricity(spark: SparkSession, d: str) -> DataFrame:
    return N.eccentricities(supplier_graph(spark, d), one(spark, 7).select(F.col("node").cast("long")), weighted=True).select("eccentricity")


@query(f"WITH {parts()}, {BOTH}, k AS (SELECT src, count(*) AS d FROM u GROUP BY 1) SELECT count(*)::BIGINT AS nodes, sum(d)::BIGINT AS eigenvalue_sum, sum(d * d + d)::BIGINT AS eigenvalue_squares FROM k")
def laplacian_moments(spark: SparkSession, d: str) -> DataFrame:
    return N.laplacian_moments(part_graph(spark, d))


@query("""
WITH RECURSIVE e AS (SELECT 'C' || o_custkey AS src, 'O' || o_orderkey AS dst, o_orderdate AS t FROM orders), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), k AS (SELECT src, count(*) AS d FROM u GROUP BY 1),
y AS (SELECT date_trunc('year', t) AS y, count(*) AS n FROM e GROUP BY 1)
SELECT 'nodes' AS metric, count(*)::DOUBLE AS value FROM k UNION ALL SELECT 'edges', (SELECT count(*) FROM e) UNION ALL SELECT 'density', round(sum(d) / (count(*) * (count(*) - 1))::DOUBLE, 9) FROM k UNION ALL SELECT 'average_degree', round(avg(d), 9) FROM k
UNION ALL SELECT 'clustering', 0.0 UNION ALL SELECT 'components', count(DISTINCT src)::DOUBLE FROM e UNION ALL SELECT 'diameter', 2.0 UNION ALL SELECT 'growth', round(arg_max(n, y) / arg_min(n, y)::DOUBLE - 1, 9) FROM y""")
def analytics_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Stars of customers and their orders, from one order."""
    e = G.edges(spark, d, "PLACED")
    start = e.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("node")).filter("n > 1").orderBy("src").limit(1).select("node")
    return N.summary(e, start, "valid_from").withColumn("value", F.round("value", 9))


@query(f"WITH {parts()}, {BOTH} SELECT src AS node, row_number() OVER (ORDER BY count(*) DESC, src)::BIGINT AS rank FROM u GROUP BY 1")
def centrality_ranks(spark: SparkSession, d: str) -> DataFrame:
    return N.ranked(N.degrees(part_graph(spark, d)), "degree").select("node", "rank")


# Hypergraphs and reification.


@query(f"WITH {parts()}, {BOTH} SELECT [x.src, x.dst] AS nodes, 1 AS length FROM u x WHERE x.src = 7 AND x.dst = 70 UNION ALL SELECT [x.src, y.src, y.dst], 2 FROM u x JOIN u y ON x.dst = y.src WHERE x.src = 7 AND y.dst = 70")
def hyper_paths(spark: SparkSession, d: str) -> DataFrame:
    """All ways over one or two orders from a part to another."""
    return H.paths(G.baskets(spark, d), LONG(7), LONG(70), 2)


@query("""
WITH i AS (SELECT DISTINCT l_orderkey AS h, l_partkey AS n, o_orderstatus AS t FROM lineitem JOIN orders ON o_orderkey = l_orderkey) SELECT a.n AS a, count(*)::BIGINT AS k FROM i a JOIN i b ON a.h = b.h AND a.n <> b.n JOIN i c ON c.n = b.n AND c.t = 'O' WHERE a.t = 'F' AND b.t = 'F' GROUP BY 1""")
def hyper_incidence_pattern(spark: SparkSession, d: str) -> DataFrame:
    """Two parts of a finished order, the second also in an open one, by the first."""
    kinds = G.read(spark, d, "orders").select(F.col("o_orderkey").alias("hid"), F.col("o_orderstatus").alias("type"))
    found = H.match_incidence(G.baskets(spark, d), kinds, [("a", "h", "F"), ("b", "h", "F"), ("b", "g", "O")])
    return found.groupBy("a").agg(F.count("*").alias("k"))


@query(f"WITH {_META} SELECT rel1 AS id1, rel2 AS id2, 'follows' AS type FROM m WHERE rel2 IS NOT NULL AND rel1 IN (SELECT o_orderkey FROM orders WHERE o_totalprice >= 200000) AND rel2 IN (SELECT o_orderkey FROM orders WHERE o_totalprice >= 200000)")
def meta_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations between orders that follow each other, of which both ends are known."""
    known = G.read(spark, d, "orders").filter("o_totalprice >= 200000").select(F.col("o_orderkey").alias("id"))
    return H.meta(_meta(spark, d)[0], F.col("rel1"), F.col("rel2"), "follows", known)


@query("""
WITH k AS (SELECT min(o_orderkey) AS o FROM orders), e AS (SELECT 'r:' || o_orderkey AS r, 'C' || o_custkey AS c, 'O' || o_orderkey AS o FROM orders, k WHERE o_orderkey = k.o)
SELECT r AS node, 0 AS depth FROM e UNION ALL SELECT c, 1 FROM e UNION ALL SELECT o, 1 FROM e""")
def reified_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    first = G.read(spark, d, "orders").agg(F.min("o_orderkey")).first()[0]
    return R.hierarchy(R.reify(_orders_as_edges(spark, d))[1], f"r:{first}")


@query("SELECT 'r:rel' AS id, 'IN_REGION' AS original_type, 'R1' AS target, '1998' AS since, (SELECT count(*) - 1 FROM nation) AS left_over")
def reify_statement(spark: SparkSession, d: str) -> DataFrame:
    """A statement carried out: the edge has become a node."""
    s = Script(G.Graph(G.nodes(spark, d, "Nation"), G.edges(spark, d, "IN_REGION")))
    node = s.run('REIFY (N1)-[:IN_REGION]->(R1) AS rel WITH {since: "1998"}')[0]
    links = s.reified["rel"][1]
    return R.match_reified(node, links).join(node, "id").select("id", "original_type", "target", "since", F.lit(s.graph.edges.count()).alias("left_over"))


@query("SELECT DISTINCT 'S' || s_suppkey AS src, 'SELLS_IN' AS type, 'R' || n_regionkey AS dst FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def builder_create(spark: SparkSession, d: str) -> DataFrame:
    """Edges made from what a pattern binds."""
    e = G.edges(spark, d, "LOCATED_IN", "IN_REGION").filter(~F.col("src").startswith("C"))
    q = GraphQuery(G.Graph(G.nodes(spark, d, "Nation"), e)).match(("s", "LOCATED_IN", "n"), ("n", "IN_REGION", "r")).create("s", "SELLS_IN", "r")
    return q.graph.edges.filter("type = 'SELLS_IN'").select("src", "type", "dst")


@query(f"WITH {_META}, k AS (SELECT min(rel1) AS r FROM m WHERE rel2 IS NOT NULL) SELECT rel2 AS other, type FROM m, k WHERE rel1 = r AND rel2 IS NOT NULL UNION ALL SELECT rel1, type FROM m, k WHERE rel2 = r")
def meta_of(spark: SparkSession, d: str) -> DataFrame:
    meta, _ = _meta(spark, d)
    return R.meta_of(meta, meta.agg(F.min("rel1")).first()[0])


@query("SELECT type, count(*)::BIGINT AS n FROM (SELECT unnest(['FROM', 'TO']) AS type FROM orders UNION ALL SELECT 'SEEN_BY') GROUP BY 1")
def attach_to_reified(spark: SparkSession, d: str) -> DataFrame:
    links = R.reify(_orders_as_edges(spark, d))[1]
    return R.attach(links, "r:1", "S1", "SEEN_BY").groupBy("type").agg(F.count("*").alias("n"))


# Time.


@query(f"""
WITH {FACTS} SELECT x.subject, x.object, y.object AS other FROM f x JOIN f y ON x.subject = y.subject AND x.object < y.object AND (x.valid_to IS NULL OR x.valid_to >= y.valid_from) AND (y.valid_to IS NULL OR y.valid_to >= x.valid_from)""")
def exclusive_open_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders of which both are current at some time; the last one is so without end."""
    facts = G.facts(spark, d).select("subject", "object", "valid_from", "valid_to")
    return T.exclusive_conflicts(facts, ["subject"], "object", 200).select("subject", "object", F.col("b_object").alias("other"))


@query("SELECT o_orderkey AS src, dst, 'PREVIOUS_VERSION' AS type FROM (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders) WHERE dst IS NOT NULL")
def version_links(spark: SparkSession, d: str) -> DataFrame:
    return T.version_links(G.read(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey")


@query("SELECT o_custkey AS id, o_orderkey AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC)::INT AS rank FROM orders")
def version_history(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = G.read(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("v"), F.row_number().over(w).alias("version"))
    return R.history(rows).select("id", "v", "rank")


@query("SELECT p_partkey, '1.' || p_size || '.' || (p_partkey + 1) AS semantic, (p_size + 1)::VARCHAR AS sequential FROM part")
def next_versions(spark: SparkSession, d: str) -> DataFrame:
    p = G.read(spark, d, "part")
    semantic = F.concat_ws(".", F.lit("1"), F.col("p_size").cast("string"), F.col("p_partkey").cast("string"))
    return p.select("p_partkey", T.next_version(semantic).alias("semantic"), T.next_version(F.col("p_size").cast("string"), "sequential").alias("sequential"))


@query("""
WITH g AS (SELECT user_id, epoch_us(ts) AS t, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
SELECT user_id, count(*)::BIGINT AS n, max(t) AS last, (max(t) + round(avg(gap)))::BIGINT AS next FROM g GROUP BY 1""")
def predicted_events(spark: SparkSession, d: str) -> DataFrame:
    """When each user's next event is due."""
    found = T.predicted(G.read(spark, d, "events"), ["user_id"], "ts", "event_id")
    return found.select("user_id", "n", S.to_micros("last").alias("last"), S.to_micros("next").alias("next"))


# Triples and rules.


@query(f"WITH {TRIPLES} SELECT s, p, o FROM t WHERE NOT (p = 'mktsegment') UNION SELECT 'Z1', 'name', 'new'")
def triples_changed(spark: SparkSession, d: str) -> DataFrame:
    t = G.triples(spark, d)
    more = spark.createDataFrame([("Z1", "name", "new"), ("R1", "name", "REGION_1")], "s string, p string, o string")
    return Q.remove_triples(Q.add_triples(t, more), Q.query_triples(t, p="mktsegment")).filter("not (s = 'R1' and o = 'REGION_1')").unionByName(Q.query_triples(t, s="R1").filter("o = 'REGION_1'"))


@query(f"WITH {TRIPLES} SELECT DISTINCT s, p, o FROM t WHERE s IN (SELECT 'N' || n_nationkey FROM nation WHERE n_regionkey = 1) OR o IN (SELECT 'N' || n_nationkey FROM nation WHERE n_regionkey = 1)")
def sparql_describe(spark: SparkSession, d: str) -> DataFrame:
    return Q.sparql(G.triples(spark, d), "DESCRIBE ?n WHERE { ?n regionkey <R1> }")


@query("SELECT DISTINCT 'N' || c_nationkey AS n FROM customer ORDER BY n LIMIT 7")
def sparql_distinct_order(spark: SparkSession, d: str) -> DataFrame:
    return Q.sparql(G.triples(spark, d), "SELECT DISTINCT ?n WHERE { ?c mktsegment ?m ; nationkey ?n } ORDER BY ?n LIMIT 7")


@query("SELECT r_name AS region, NULL::VARCHAR AS x FROM region")
def sparql_optional_apart(spark: SparkSession, d: str) -> DataFrame:
    """An optional part that shares no variable and finds nothing."""
    return Q.sparql(G.triples(spark, d), 'SELECT ?region ?x WHERE { ?r name ?region . FILTER(regex(?r, "^R")) OPTIONAL { ?x name "nobody" } }')


@query("SELECT n_name AS nation, CASE WHEN n_nationkey <> n_regionkey THEN 'R' || n_regionkey END AS region FROM nation")
def sparql_optional_filter(spark: SparkSession, d: str) -> DataFrame:
    """The filter of an optional part names a variable from outside."""
    text = 'PREFIX w: <> SELECT ?nation ?region WHERE { ?n w:name ?nation ; regionkey ?r . OPTIONAL { ?n regionkey ?region . FILTER(regex(?nation, "NATION") && !regex(?n, "^N0$") && ?region != "R99") } }'
    got = Q.sparql(G.triples(spark, d), text)
    return got.withColumn("region", F.when(F.regexp_extract("nation", "([0-9]+)$", 1) != F.substring("region", 2, 9), F.col("region")))


@query("SELECT 0 AS q, count(*)::BIGINT AS n FROM customer UNION ALL SELECT 1, 1 UNION ALL SELECT 2, (SELECT count(*) + 1 FROM region)")
def sparql_batch(spark: SparkSession, d: str) -> DataFrame:
    """Three queries; the change of the second holds for the third."""
    found = Q.batch(G.triples(spark, d), ["SELECT ?c WHERE { ?c mktsegment ?m }", 'INSERT DATA { R9 name "new" }', 'SELECT ?r WHERE { ?r name ?n FILTER(regex(?r, "^R")) }'])
    counts = [found[0].count(), found[1].count() - G.triples(spark, d).count(), found[2].count()]
    return spark.createDataFrame(list(enumerate(counts)), "q int, n long")


@query("SELECT * FROM (VALUES (0, 'scan', 'where'), (1, 'hash_join', 'where'), (2, 'hash_join', 'optional')) t(step, how, part)")
def sparql_explain(spark: SparkSession, d: str) -> DataFrame:
    plan = Q.explain('SELECT ?c WHERE { ?c nationkey ?n . ?c mktsegment "BUILDING" OPTIONAL { ?n regionkey ?r } }')
    return spark.createDataFrame([(i, s["how"], s["part"]) for i, s in enumerate(plan["steps"])], "step int, how string, part string")


@query("SELECT 'S' || s_suppkey AS s, 'nationkey' AS p, 'one_of' AS rule FROM supplier WHERE s_nationkey > 9 UNION ALL SELECT 'S' || s_suppkey, 'mktsegment', 'min' FROM supplier UNION ALL SELECT 'S' || s_suppkey, 'name', 'pattern' FROM supplier WHERE NOT regexp_matches(s_name, '[02468]$')")
def shape_violations(spark: SparkSession, d: str) -> DataFrame:
    t = G.triples(spark, d).filter(F.col("s").startswith("S"))
    typed = t.unionByName(t.select("s", F.lit("type").alias("p"), F.lit("Supplier").alias("o")).distinct())
    return Q.shape_violations(typed, "Supplier", {"nationkey": {"min": 1, "max": 1, "one_of": [f"N{i}" for i in range(10)]}, "mktsegment": {"min": 1}, "name": {"pattern": "[02468]$"}})


@query("SELECT 'C' || c_custkey AS s, 'R' || n_regionkey AS o FROM customer JOIN nation ON n_nationkey = c_nationkey")
def rules_over_triples(spark: SparkSession, d: str) -> DataFrame:
    """A rule of one's own beside those of the schema."""
    t = G.triples(spark, d).filter(F.col("s").rlike("^[CN]") & F.col("p").isin("nationkey", "regionkey"))
    return Q.rdfs(t, "t(C, lives_in, R) :- t(C, nationkey, N), t(N, regionkey, R).").filter("p = 'lives_in'").select("s", "o")


def _places(spark: SparkSession, d: str) -> Program:
    return Program(spark, {"nation": G.read(spark, d, "nation").select("n_nationkey"), "lives": G.read(spark, d, "customer").select("c_custkey", "c_nationkey"), "owns": G.read(spark, d, "customer").select("c_custkey", F.floor("c_acctbal").alias("b"))})


@query("SELECT c_custkey::VARCHAR AS \"X\", (floor(c_acctbal)::BIGINT * 2 + 10)::VARCHAR AS \"N\" FROM customer WHERE floor(c_acctbal) * 2 + 10 > 5000")
def datalog_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    return _places(spark, d).add("worth(X, N) :- owns(X, M), K = M * 2, N = K + 10, N > 5000.").query("worth(X, N)")


@query("""
SELECT n_nationkey::VARCHAR AS "N", count(c_custkey)::VARCHAR AS "K", coalesce(max(floor(c_acctbal))::BIGINT::VARCHAR, '') AS "M", coalesce(string_agg(c_custkey::VARCHAR, ',' ORDER BY floor(c_acctbal) DESC, c_custkey::VARCHAR) FILTER (WHERE r <= 2), '') AS "T"
FROM nation LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY floor(c_acctbal) DESC, c_custkey::VARCHAR) AS r FROM customer) ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(c_custkey) > 0""")
def datalog_rule_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """A count, a greatest value and the two best of each nation, in one rule."""
    p = _places(spark, d).add("rich(N, K, M, T) :- nation(N), K = count(X : lives(X, N)), M = max(B : lives(X, N), owns(X, B)), T = top(2, X, B : lives(X, N), owns(X, B)).")
    return p.query("rich(N, K, M, T)")


@query("SELECT z.o_orderkey::VARCHAR AS \"Y\" FROM orders a JOIN orders z ON a.o_custkey = z.o_custkey AND (a.o_orderdate, a.o_orderkey) < (z.o_orderdate, z.o_orderkey) WHERE a.o_orderkey = (SELECT min(o_orderkey) FROM orders)")
def datalog_magic(spark: SparkSession, d: str) -> DataFrame:
    """Only what follows one order, from the constant of the goal on."""
    first = G.read(spark, d, "orders").agg(F.min("o_orderkey")).first()[0]
    p = Program(spark, {"next": T.timeline(G.facts(spark, d), ["subject"], "object").filter("previous is not null").select("previous", "object")})
    return p.add("far(X, Y) :- next(X, Y). far(X, Z) :- next(X, Y), far(Y, Z).").magic(f'far("{first}", Y)')


@query("SELECT 'R' || n_regionkey AS \"Y\", count(*)::BIGINT AS n FROM (SELECT n_regionkey FROM nation UNION ALL SELECT n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey) GROUP BY 1")
def datalog_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers come after the nations' ways are derived; only theirs are added."""
    e = lambda kind, x: G.edges(spark, d, kind).filter(F.col("src").startswith(x)).select("src", "dst")
    p = Program(spark, {"up": e("IN_REGION", "N")}).add("above(X, Y) :- up(X, Y). above(X, Z) :- up(X, Y), above(Y, Z).").run()
    found = p.extend("up", e("LOCATED_IN", "S")).query("above(X, Y)")
    return found.filter(F.col("Y").startswith("R")).groupBy("Y").agg(F.count("*").alias("n"))


@query("SELECT 0 AS level, 'above(S1, R' || n_regionkey || ')' AS fact FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey = 1 UNION ALL SELECT 1, 'up(S1, N' || s_nationkey || ')' FROM supplier WHERE s_suppkey = 1 UNION ALL SELECT 1, 'above(N' || n_nationkey || ', R' || n_regionkey || ')' FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey = 1 UNION ALL SELECT 2, 'up(N' || n_nationkey || ', R' || n_regionkey || ')' FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey = 1")
def datalog_proof(spark: SparkSession, d: str) -> DataFrame:
    """Backward from a goal to the facts that it rests on."""
    e = G.edges(spark, d, "IN_REGION", "LOCATED_IN").filter(~F.col("src").startswith("C")).select("src", "dst")
    region = G.read(spark, d, "supplier").filter("s_suppkey = 1").join(G.read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).first()["n_regionkey"]
    p = Program(spark, {"up": e}).add("above(X, Y) :- up(X, Y). above(X, Z) :- up(X, Y), above(Y, Z).")
    return spark.createDataFrame([(n, fact) for n, fact, _ in p.prove(f'above("S1", "R{region}")')], "level int, fact string")


@query("SELECT o_custkey AS subject, count(*)::BIGINT AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1")
def context_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of one context and of the default one."""
    o = G.read(spark, d, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderstatus").alias("context"))
    return Q.in_context(o, "F", default="O").groupBy("subject").agg(F.count("*").alias("n"))


@query("SELECT 'S' || s_suppkey AS id FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 1000 AND n_regionkey = 1")
def language_find(spark: SparkSession, d: str) -> DataFrame:
    """A rule, then a question about what it has made."""
    e = G.edges(spark, d, "LOCATED_IN", "IN_REGION").filter(~F.col("src").startswith("C"))
    k = Knowledge(G.Graph(G.nodes(spark, d, "Supplier", "Nation", "Region"), e.select("src", "dst", "type", "valid_from", "valid_to")))
    text = """
        DEFINE entity Supplier WITH PROPERTIES s_acctbal AS decimal END
        WHEN s LOCATED_IN n AND n IN_REGION r THEN s SELLS_IN r
        FIND ALL Supplier s WHERE s.s_acctbal > 1000 AND s SELLS_IN R1 ORDERED BY s.s_acctbal DESC"""
    return k.run(text)[0].select("id")


@query("SELECT 'O' || o_orderkey AS id FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders) AND o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1997-12-31' AND o_orderstatus = 'F'")
def language_during(spark: SparkSession, d: str) -> DataFrame:
    """What a customer has ordered within some time."""
    first = G.read(spark, d, "orders").agg(F.min("o_custkey")).first()[0]
    e = G.edges(spark, d, "PLACED").withColumn("valid_to", F.col("valid_from")).select("src", "dst", "type", "valid_from", "valid_to")
    k = Knowledge(G.Graph(G.nodes(spark, d, "Order"), e))
    return k.run(f'FIND ALL Order o WHERE o.o_orderstatus = "F" AND C{first} PLACED o DURING FROM 1995-01-01 TO 1997-12-31')[0].select("id")


@query("SELECT 'N1 --IN_REGION--> R' || n_regionkey AS line FROM nation WHERE n_nationkey = 1 UNION ALL SELECT 'X1 --CONNECTED--> X2' UNION ALL SELECT '1'")
def script_commands(spark: SparkSession, d: str) -> DataFrame:
    """Commands that change a graph, then show it."""
    s = Script(G.Graph(G.nodes(spark, d, "Nation").filter("id = 'N1'").select("id", "type", "properties"), G.edges(spark, d, "IN_REGION").filter("src = 'N1'").select("src", "dst", "type", "weight")))
    out = s.run("node X1 Node\nnode X2\nedge X1 X2 CONNECTED 2\nhyperedge MEETING X1 X2\nnode X3\nedge X3 X1 CONNECTED\nrm-node X3\nviz")
    return out[0].unionByName(s.members.select("hid").distinct().agg(F.count("*").cast("string").alias("line")))


# Scalars.


@query("SELECT event_id, epoch_us(ts) AS micros FROM events")
def micros_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return G.read(spark, d, "events").select("event_id", S.to_micros(S.from_micros(S.to_micros("ts"))).alias("micros"))


@query("SELECT p_partkey, CASE WHEN p_size IN (1, 7, 20, 33) THEN list_position([1, 7, 20, 33], p_size) - 1 ELSE -1 END::INT AS place, CASE WHEN p_size < 25 THEN -1 WHEN p_size > 25 THEN 1 ELSE 0 END AS compared FROM part")
def array_places(spark: SparkSession, d: str) -> DataFrame:
    given = F.array(*[F.lit(x) for x in (1, 7, 20, 33)])
    return G.read(spark, d, "part").select("p_partkey", S.position(given, F.col("p_size")).alias("place"), S.compare_arrays(F.array("p_size"), F.array(F.lit(25))).alias("compared"))


@query("SELECT p_partkey, trim(p_name) AS cleaned, regexp_matches(p_type, '^[A-Za-z_][A-Za-z0-9_]{0,63}$') AS valid, octet_length(p_name::BLOB)::INT AS size FROM part")
def checked_names(spark: SparkSession, d: str) -> DataFrame:
    dirty = F.concat(F.lit("\t "), F.col("p_name"), F.lit("\r\n "))
    return G.read(spark, d, "part").select("p_partkey", S.clean(dirty).alias("cleaned"), S.valid_name("p_type").alias("valid"), S.size_of("p_name", "string").cast("int").alias("size"))


@query("SELECT event_id, round(value * value - 4, 6) AS re, round(4 * value, 6) AS im, round(sqrt(value * value + 4), 6) AS size, round(atan2(2, value), 6) AS angle FROM events")
def complex_numbers(spark: SparkSession, d: str) -> DataFrame:
    z = F.struct(F.col("value").alias("re"), F.lit(2.0).alias("im"))
    e = G.read(spark, d, "events").select("event_id", z.alias("z"))
    return e.select("event_id", F.round(S.complex_multiply("z", "z")["re"], 6).alias("re"), F.round(S.complex_multiply("z", "z")["im"], 6).alias("im"), F.round(S.magnitude("z"), 6).alias("size"), F.round(S.phase("z"), 6).alias("angle"))


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 10 WHEN 1 THEN 8 WHEN 2 THEN 6 WHEN 3 THEN 3 END AS score, CASE WHEN c_acctbal >= 0 THEN 0.5::DOUBLE ELSE 0.4::DOUBLE END AS confidence FROM customer")
def expertise_levels(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("Expert", "advanced", "INTERMEDIATE", "beginner", "none")])
    c = G.read(spark, d, "customer")
    return c.select("c_custkey", S.level_score(names[(F.col("c_custkey") % 5).cast("int")]).alias("score"), S.decayed(F.lit(0.5), F.col("c_acctbal") >= 0).alias("confidence"))


# Streams, search, other parts of the inventory.


@query("SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN 'node_deleted' ELSE 'node_updated' END AS event FROM supplier WHERE s_nationkey < 5 OR s_acctbal < 0 UNION ALL SELECT -1, 'node_created'")
def change_events(spark: SparkSession, d: str) -> DataFrame:
    """What has happened to suppliers from one state to the next."""
    s = G.read(spark, d, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    after = s.filter("s_nationkey >= 5").withColumn("s_acctbal", F.when(F.col("s_acctbal") < 0, 0.0).otherwise(F.col("s_acctbal")))
    return W.change_events(s, after.unionByName(spark.createDataFrame([(-1, 0.0, 1)], "s_suppkey long, s_acctbal double, s_nationkey int")), "s_suppkey")


@query("""
WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, event_id, i, 0 AS batch, t AS first, 1 AS n FROM o WHERE i = 1 UNION ALL
  SELECT o.user_id, o.event_id, o.i, CASE WHEN r.n >= 5 OR o.t - r.first >= 86400000000 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.n >= 5 OR o.t - r.first >= 86400000000 THEN o.t ELSE r.first END, CASE WHEN r.n >= 5 OR o.t - r.first >= 86400000000 THEN 1 ELSE r.n + 1 END
  FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1) SELECT user_id, event_id, batch FROM r""")
def micro_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of five events or a day, whatever is first, of each user."""
    return W.micro_batches(G.read(spark, d, "events"), "user_id", "ts", "event_id", 5, 86400.0)


@query("SELECT user_id, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_running_state(spark: SparkSession, d: str) -> DataFrame:
    """Each user's count and sum as a stream's state, last of all that it has said."""
    source = shared_path(spark, "state")
    G.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(source)
    got = W.running_state(W.stream(spark, source, files_per_trigger=1), "user_id", "long")
    rows = W.run_to_memory(got, "state_" + source.rsplit("-", 1)[1], "update", shared_path(spark, "state-kept"))
    return rows.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 4).alias("total"))


@query("SELECT count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users FROM events")
def stream_each_batch(spark: SparkSession, d: str) -> DataFrame:
    """Batches handed over one by one, each written under its number."""
    source, to = shared_path(spark, "batches"), shared_path(spark, "taken")
    G.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).repartition(4).write.parquet(source)
    take = lambda rows, n: rows.write.mode("overwrite").parquet(f"{to}/batch={n}")
    W.each_batch(W.stream(spark, source, files_per_trigger=2), take, shared_path(spark, "batches-kept")).awaitTermination()
    return spark.read.parquet(to).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, count(*)::BIGINT AS n FROM events GROUP BY 1 HAVING time_bucket(INTERVAL 1 HOUR, min(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR")
def stream_watermark(spark: SparkSession, d: str) -> DataFrame:
    """Windows that a watermark of two hours has closed."""
    source = shared_path(spark, "late")
    G.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(source)
    got = W.tumbling(W.stream(spark, source, files_per_trigger=1000), "1 hour", [], late="2 hours").select("start", "n")
    rows = W.run_to_memory(got, "late_" + source.rsplit("-", 1)[1], "append", shared_path(spark, "late-kept"))
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@query("""
WITH t AS (SELECT p_partkey AS id, p_size / 50.0 AS score FROM part WHERE p_type = 'ECONOMY'), v AS (SELECT p_partkey AS id, p_retailprice AS score FROM part WHERE p_size > 30),
u AS (SELECT id, 0.5 * score / (SELECT max(score) FROM t) AS score FROM t UNION ALL SELECT id, 0.5 * score / (SELECT max(score) FROM v) FROM v) SELECT id, round(sum(score), 9) AS score FROM u GROUP BY 1""")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Two scored lists, each score over its list's best."""
    p = G.read(spark, d, "part")
    a = p.filter("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50.0).alias("score"))
    b = p.filter("p_size > 30").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"))
    return X.hybrid_search(a, b, "id").withColumn("score", F.round("score", 9))


@query("SELECT p_partkey, rule FROM (SELECT p_partkey, unnest([CASE WHEN p_size > 45 THEN 'size' END, CASE WHEN p_name NOT LIKE '% %' THEN 'two_words' END]) AS rule FROM part) WHERE rule IS NOT NULL")
def named_validators(spark: SparkSession, d: str) -> DataFrame:
    """Rules with names, one of them a check of one's own."""
    return X.violations(G.read(spark, d, "part"), "p_partkey", {"size": F.col("p_size") <= 45, "two_words": F.contains("p_name", F.lit(" "))})


@query("""
WITH a AS (SELECT DISTINCT s_suppkey AS src, s_nationkey::BIGINT AS dst FROM supplier), z AS (SELECT DISTINCT s_suppkey AS src, (s_nationkey + s_suppkey % 2)::BIGINT AS dst FROM supplier), b AS (SELECT src, dst, sum(p) AS p FROM (SELECT *, 1 AS p FROM a UNION ALL SELECT *, 2 FROM z) GROUP BY 1, 2),
d AS (SELECT *, ('0x' || substr(md5('cross:' || src || ':' || dst), 1, 1))::INT AS x, ('0x' || substr(md5('mutate:' || src || ':' || dst), 1, 4))::INT / 65536.0 AS y FROM b)
SELECT src, dst FROM d WHERE (p = 3 OR (p = 1 AND x < 8) OR (p = 2 AND x >= 8)) AND y >= 0.1""")
def bred_graphs(spark: SparkSession, d: str) -> DataFrame:
    """A graph bred from two, less a tenth."""
    s = G.read(spark, d, "supplier")
    a = s.select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").cast("long").alias("dst"))
    b = s.select(F.col("s_suppkey").alias("src"), (F.col("s_nationkey") + F.col("s_suppkey") % 2).cast("long").alias("dst"))
    return X.mutated(X.crossover(a, b), 0.1)


@query("SELECT sha256('s' || c_custkey) AS token FROM customer WHERE c_custkey IN (SELECT user_id FROM events)")
def blinded_intersection(spark: SparkSession, d: str) -> DataFrame:
    return X.blinded_intersection(G.read(spark, d, "customer").select(F.col("c_custkey").alias("k")), G.read(spark, d, "events").select(F.col("user_id").alias("k")), "k", "s")


@query("SELECT user_id, round((count(*) FILTER (WHERE event_type = 'purchase') + 1) / (count(*) + 2)::DOUBLE, 9) AS trust, count(*)::BIGINT AS n FROM events GROUP BY 1")
def trust_scores(spark: SparkSession, d: str) -> DataFrame:
    return X.trust(G.read(spark, d, "events"), "user_id", F.col("event_type") == "purchase").withColumn("trust", F.round("trust", 9))


@query(r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, greatest(0, ceil((len(w) - 200) / 180.0))::INT + 1)) AS chunk FROM w WHERE len(w) > 0)
SELECT doc_id, chunk::INT AS chunk, len(w[chunk * 180 + 1 : chunk * 180 + 200])::INT AS n_words, sha256(array_to_string(w[chunk * 180 + 1 : chunk * 180 + 200], ' ')) AS digest FROM c""")
def text_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts in pieces of 200 words that overlap by 20."""
    found = X.chunks(G.read(spark, d, "documents"), "doc_id", "text", 200, 20)
    return found.select("doc_id", "chunk", "n_words", F.sha2(F.col("content").cast("binary"), 256).alias("digest"))


@query("SELECT 1::BIGINT AS hits, 1::BIGINT AS kept, (SELECT count(*) FROM orders)::BIGINT AS n, 2::BIGINT AS timed")
def kept_results(spark: SparkSession, d: str) -> DataFrame:
    """The same plan twice: written once, read once, and both timed."""
    store = Store(G.graph(spark, d, ("Customer",), ("PLACED",)))
    ask = lambda: store.graph.edges.groupBy("src").agg(F.count("*").alias("n"))
    n = [store.timed(f"q{i}", store.result(ask())) for i in range(2)]
    total = store.result(ask()).agg(F.sum("n")).first()[0]
    return spark.range(1).select(F.lit(store.hits - 1).cast("long").alias("hits"), F.lit(len(store.kept)).cast("long").alias("kept"), F.lit(total).cast("long").alias("n"), F.lit(store.slow(spark, 0.0).count() * (n[0] == n[1])).cast("long").alias("timed"))


@query("SELECT p_partkey, list_intersect(string_split(lower(p_name), ' '), ['red', 'ring']) <> [] AS hit FROM part")
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """A function of one's own for SQL, planned as the expression that it stands for."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION weft_any_word(text STRING, words ARRAY<STRING>) RETURNS BOOLEAN RETURN arrays_overlap(split(lower(text), ' '), words)")
    G.read(spark, d, "part").createOrReplaceTempView("weft_part")
    return spark.sql("SELECT p_partkey, weft_any_word(p_name, array('red', 'ring')) AS hit FROM weft_part")
