"""Graph, tree, ontology and review queries over a graph made of the business tables."""

from pyspark.sql import functions as F

from fieldglass.operators import causal, graph, ontology, predicates, review, tree
from fieldglass.plans.registry import register
from fieldglass.session import union_all


def _id(letter, column):
    return F.concat(F.lit(letter), F.col(column).cast("string"))


def edges(t):
    e = lambda df, a, b, r: df.select(a.alias("from_id"), b.alias("to_id"), F.lit(r).alias("relation"))
    return union_all(
        [
            e(t.nation, _id("N", "n_nationkey"), _id("R", "n_regionkey"), "INCLUDES"),
            e(t.customer, _id("C", "c_custkey"), _id("N", "c_nationkey"), "REALIZED_BY"),
            e(t.supplier, _id("S", "s_suppkey"), _id("N", "s_nationkey"), "REALIZED_BY"),
            e(t.orders, _id("O", "o_orderkey"), _id("C", "o_custkey"), "MEASURED_BY"),
        ]
    )


def nodes(t):
    n = lambda df, i, name, kind, gen: df.select(i.alias("id"), name.alias("name"), F.lit(kind).alias("node_type"), gen.alias("gen"))
    none = F.lit(None).cast("string")
    return union_all(
        [
            n(t.region, _id("R", "r_regionkey"), F.col("r_name"), "control_group", none),
            n(t.nation, _id("N", "n_nationkey"), F.col("n_name"), "function", F.lit("both")),
            n(t.customer, _id("C", "c_custkey"), F.col("c_name"), "feature", F.when(F.col("c_custkey") % 2 == 0, "5G").otherwise("4G")),
            n(t.supplier, _id("S", "s_suppkey"), F.col("s_name"), "feature", F.lit("5G")),
            n(t.orders, _id("O", "o_orderkey"), F.col("o_orderstatus"), "kpi", none),
        ]
    )


_E = """WITH e AS (SELECT 'N'||n_nationkey AS f, 'R'||n_regionkey AS t, 'INCLUDES' AS relation FROM nation UNION ALL
  SELECT 'C'||c_custkey, 'N'||c_nationkey, 'REALIZED_BY' FROM customer UNION ALL SELECT 'S'||s_suppkey, 'N'||s_nationkey, 'REALIZED_BY' FROM supplier
  UNION ALL SELECT 'O'||o_orderkey, 'C'||o_custkey, 'MEASURED_BY' FROM orders)"""
_N = _E + """, n AS (SELECT 'R'||r_regionkey AS id, r_name AS name, 'control_group' AS node_type, NULL::VARCHAR AS gen FROM region UNION ALL
  SELECT 'N'||n_nationkey, n_name, 'function', 'both' FROM nation UNION ALL
  SELECT 'C'||c_custkey, c_name, 'feature', CASE WHEN c_custkey%2=0 THEN '5G' ELSE '4G' END FROM customer UNION ALL
  SELECT 'S'||s_suppkey, s_name, 'feature', '5G' FROM supplier UNION ALL SELECT 'O'||o_orderkey, o_orderstatus, 'kpi', NULL FROM orders)"""
_HOP = _E + """, b AS (SELECT f AS a, t AS z FROM e UNION ALL SELECT t, f FROM e),
 h0 AS (SELECT DISTINCT a AS id FROM b WHERE a IN ('N3','C7','Q1')), h1 AS (SELECT id FROM h0 UNION SELECT z FROM b JOIN h0 ON a=id),
 h2 AS (SELECT id FROM h1 UNION SELECT z FROM b JOIN h1 ON a=id)
"""


def _seeds(t):
    return t.spark.createDataFrame([("N3",), ("C7",), ("Q1",)], "id string")


@register(
    "khop",
    _HOP
    + "SELECT id, CASE WHEN id IN (SELECT id FROM h0) THEN 0 WHEN id IN (SELECT id FROM h1) THEN 1 ELSE 2 END AS hop FROM h2",
)
def khop(t):
    return graph.neighbourhood(edges(t), _seeds(t), 2)


@register(
    "induced_edges",
    _HOP + "SELECT f AS from_id, t AS to_id, relation FROM e WHERE f IN (SELECT id FROM h2) AND t IN (SELECT id FROM h2)",
)
def induced_edges(t):
    return graph.induced_edges(edges(t), graph.neighbourhood(edges(t), _seeds(t), 2)).select("from_id", "to_id", "relation")


@register(
    "subgraph_generation",
    _N
    + _HOP.replace(_E, "")
    + ", g AS (SELECT n.* FROM n JOIN h2 USING (id) WHERE gen IS NULL OR gen IN ('5G','both')) SELECT f AS from_id, t AS to_id FROM e WHERE f IN (SELECT id FROM g) AND t IN (SELECT id FROM g)",
)
def subgraph_generation(t):
    _, kept = graph.subgraph(nodes(t), edges(t), _seeds(t), 2, "5G")
    return kept.select("from_id", "to_id")


@register("successors", _N + "SELECT f AS from_id, t AS to_id, relation, name, node_type FROM e JOIN n ON n.id=e.t")
def successors(t):
    return graph.successors(nodes(t), edges(t)).select("from_id", "to_id", "relation", "name", "node_type")


@register("graph_counts", _N + "SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges")
def graph_counts(t):
    return graph.counts(nodes(t), edges(t))


@register("node_filter", _N + "SELECT id, name FROM n WHERE node_type='feature'")
def node_filter(t):
    return nodes(t).filter(predicates.node_filter("feature")).select("id", "name")


def scored_edges(t):
    li = t.lineitem
    return li.select(
        _id("O", "l_orderkey").alias("from_id"),
        _id("S", "l_suppkey").alias("to_id"),
        F.when(F.col("l_linenumber") % 2 == 0, "AFFECTS").otherwise("TUNED_BY").alias("relation"),
        F.when(F.col("l_linestatus") == "O", "pending").when(F.col("l_returnflag") == "R", "rejected").otherwise("approved").alias("status"),
        F.when(F.col("l_tax") > 0.0, F.round(1 - F.col("l_discount") * 2, 4)).alias("confidence"),
        (F.col("l_returnflag") == "A").alias("validated"),
        F.concat_ws("-", F.date_format("l_shipdate", "yyyyMMdd"), F.lpad("l_linenumber", 2, "0"), F.lpad("l_partkey", 9, "0"), F.lpad(F.col("l_extendedprice").cast("string"), 12, "0")).alias("version"),
    )


_SE = """WITH s AS (SELECT 'O'||l_orderkey AS from_id, 'S'||l_suppkey AS to_id, CASE WHEN l_linenumber%2=0 THEN 'AFFECTS' ELSE 'TUNED_BY' END AS relation,
 CASE WHEN l_linestatus='O' THEN 'pending' WHEN l_returnflag='R' THEN 'rejected' ELSE 'approved' END AS status,
 CASE WHEN l_tax>0 THEN round(1-l_discount*2,4)::DOUBLE END AS confidence, l_returnflag='A' AS validated,
 strftime(l_shipdate,'%Y%m%d') || '-' || lpad(l_linenumber::VARCHAR,2,'0') || '-' || lpad(l_partkey::VARCHAR,9,'0') || '-' || lpad(l_extendedprice::VARCHAR,12,'0') AS version FROM lineitem)
"""


@register("edge_filter", _SE + "SELECT from_id, to_id, relation, confidence FROM s WHERE confidence>=0.95 AND validated")
def edge_filter(t):
    return scored_edges(t).filter(predicates.edge_filter(0.95, True)).select("from_id", "to_id", "relation", "confidence")


@register("status_list", _SE + "SELECT status, count(*) AS n FROM s GROUP BY 1")
def status_list(t):
    return review.status_counts(scored_edges(t))


@register(
    "auto_approve",
    _SE
    + """SELECT CASE WHEN status='pending' AND coalesce(confidence,0)>=0.9 THEN 'approved' ELSE status END AS status,
    sum(CASE WHEN status='pending' AND coalesce(confidence,0)>=0.9 THEN 1 ELSE 0 END)::BIGINT AS moved, count(*) AS n FROM s GROUP BY 1""",
)
def auto_approve(t):
    q = review.auto_approve(scored_edges(t))
    return q.groupBy("status").agg(F.sum(F.col("auto").cast("long")).alias("moved"), F.count(F.lit(1)).alias("n"))


@register(
    "commit_approved",
    _SE
    + """, a AS (SELECT * FROM s WHERE status='approved')
    SELECT from_id, to_id, relation, arg_max(coalesce(confidence,1.0), version) AS confidence, true AS validated FROM a GROUP BY 1,2,3
    UNION ALL SELECT 'O'||o_orderkey, 'C'||o_custkey, 'MEASURED_BY', 0.5, false FROM orders""",
)
def commit_approved(t):
    stored = t.orders.select(
        _id("O", "o_orderkey").alias("from_id"), _id("C", "o_custkey").alias("to_id"), F.lit("MEASURED_BY").alias("relation"),
        F.lit(0.5).alias("confidence"), F.lit(False).alias("validated"),
    )
    out = review.commit_approved(scored_edges(t), stored, "version")
    return out.select("from_id", "to_id", "relation", "confidence", "validated")


@register(
    "paths_to_region",
    _E
    + """, p AS (SELECT f AS source, f || '>' || t AS path FROM e WHERE t='R2')
    , p2 AS (SELECT e.f AS source, e.f || '>' || p.path AS path FROM p JOIN e ON e.t=p.source)
    , p3 AS (SELECT e.f AS source, e.f || '>' || p2.path AS path FROM p2 JOIN e ON e.t=p2.source)
    SELECT * FROM p UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3""",
)
def paths_to_region(t):
    return graph.simple_paths_to(edges(t), "R2").select("source", F.array_join("path", ">").alias("path"))


_MODEL_PATHS = [
    ["Discount", "Margin"],
    ["Demand", "Margin"],
    ["Handling", "Margin"],
    ["Discount", "Demand", "Margin"],
    ["Demand", "Handling", "Margin"],
    ["Discount", "Demand", "Handling", "Margin"],
]


@register(
    "model_paths",
    "SELECT s_suppkey::VARCHAR || ':Margin>Margin' AS path FROM supplier UNION ALL "
    + " UNION ALL ".join(
        "SELECT " + " || '>' || ".join(f"s_suppkey || ':{v}'" for v in p) + " || '>Margin' FROM supplier"
        for p in _MODEL_PATHS
    ),
)
def model_paths(t):
    """Causal paths to the margin over one copy of the model graph per supplier."""
    k = F.col("s_suppkey").cast("string")
    name = lambda v: F.concat_ws(":", k, v if not isinstance(v, str) else F.lit(v))
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in causal.order_model().edges()]))
    inner = t.supplier.select("s_suppkey", pairs.alias("e")).select(
        name(F.col("e.a")).alias("from_id"), name(F.col("e.b")).alias("to_id")
    )
    sink = t.supplier.select(name("Margin").alias("from_id"), F.lit("Margin").alias("to_id"))
    return graph.simple_paths_to(inner.unionByName(sink), "Margin").select(F.array_join("path", ">").alias("path"))


def task_table(t):
    """Order lines as tasks that wait for the line before; some wait for a task nobody has."""
    li = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_linestatus").alias("s"), F.min("l_returnflag").alias("r"), F.min("l_partkey").alias("p")
    )
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    deps = F.when(F.col("l_linenumber") > 1, F.array(key - 1)).otherwise(F.array().cast("array<bigint>"))
    deps = F.when(F.col("p") % 50 == 0, F.array_append(deps, F.lit(-1).cast("long"))).otherwise(deps)
    return li.select(
        key.alias("id"),
        F.when(F.col("s") == "F", "true").when(F.col("r") == "R", "exceeded").otherwise("false").alias("verdict"),
        deps.alias("dependencies"),
    )


@register(
    "unblocked_tasks",
    """WITH l AS (SELECT l_orderkey, l_linenumber, min(l_linestatus) AS s, min(l_returnflag) AS r, min(l_partkey) AS p FROM lineitem GROUP BY 1,2),
       k AS (SELECT l_orderkey*10+l_linenumber AS id, (s='F' OR r='R') AS done, l_linenumber AS ln, p FROM l)
       SELECT a.id FROM k a LEFT JOIN k d ON d.id=a.id-1 AND a.ln>1 WHERE NOT a.done AND a.p%50<>0 AND (a.ln=1 OR coalesce(d.done,false))""",
)
def unblocked_tasks(t):
    return graph.unblocked(task_table(t)).select("id")


@register(
    "bridge_keys",
    """WITH r AS (SELECT 'customer' AS d, c_nationkey::VARCHAR AS k FROM customer UNION ALL SELECT 'supplier', s_nationkey::VARCHAR FROM supplier
       UNION ALL SELECT 'part', CASE WHEN p_size<25 THEN p_size::VARCHAR END FROM part)
       SELECT k AS key, count(*) AS rows, count(DISTINCT d) AS documents FROM r WHERE k IS NOT NULL GROUP BY 1""",
)
def bridge_keys(t):
    rows = union_all(
        [
            t.customer.select(F.lit("customer").alias("doc"), F.col("c_custkey").alias("row"), F.col("c_nationkey").cast("long").alias("k")),
            t.supplier.select(F.lit("supplier").alias("doc"), F.col("s_suppkey").alias("row"), F.col("s_nationkey").cast("long").alias("k")),
            t.part.select(F.lit("part").alias("doc"), F.col("p_partkey").alias("row"), F.when(F.col("p_size") < 25, F.col("p_size").cast("long")).alias("k")),
        ]
    )
    return graph.bridge_keys(rows, "doc", "row", "k")[0]


def state_notes(t):
    """Orders worded as notes on state changes."""
    k = F.col("o_orderkey")
    text = (
        F.when(k % 5 == 0, "the UE moves from RRC_IDLE to RRC_CONNECTED. then rest")
        .when(k % 5 == 1, "a change to RRC_INACTIVE from *RRC_CONNECTED* happens\nnothing here")
        .when(k % 5 == 2, "the UE shall enter RRC\\_IDLE at once")
        .when(k % 5 == 3, "RRC_IDLE alone")
        .otherwise("no state")
    )
    return t.orders.select("o_orderkey", text.alias("text"))


@register(
    "state_transitions",
    """SELECT o_orderkey, CASE o_orderkey%5 WHEN 0 THEN 'RRC_IDLE' WHEN 1 THEN 'RRC_CONNECTED' ELSE 'OTHER/ANY' END AS from_state,
       CASE o_orderkey%5 WHEN 0 THEN 'RRC_CONNECTED' WHEN 1 THEN 'RRC_INACTIVE' ELSE 'RRC_IDLE' END AS to_state,
       CASE o_orderkey%5 WHEN 0 THEN 'the UE moves from RRC_IDLE to RRC_CONNECTED. then rest' WHEN 1 THEN 'a change to RRC_INACTIVE from RRC_CONNECTED happens'
       ELSE 'the UE shall enter RRC_IDLE at once' END AS context FROM orders WHERE o_orderkey%5<3""",
)
def state_transitions(t):
    return graph.transitions(state_notes(t), "o_orderkey").select("o_orderkey", "from_state", "to_state", "context")


def tree_nodes(t):
    """Regions, nations and customers as a schema tree; every list has one leaf of its two keys."""
    info = lambda base, low=None, high=None: F.struct(
        F.lit(base).alias("base"),
        (F.array(F.struct(F.lit(low).cast("long").alias("min"), F.lit(high).cast("long").alias("max"))) if low is not None
         else F.array().cast("array<struct<min:bigint,max:bigint>>")).alias("range"),
        F.array(F.lit("[A-Z]+")).alias("pattern"),
        F.array(F.lit("F"), F.lit("O")).alias("enum"),
    )
    keys = lambda *k: F.array(*[F.lit(x) for x in k]).cast("array<string>")

    def level(df, path, parent, name, kind, key_list, type_info):
        return df.select(
            F.lit("base").alias("module"), path.alias("schema_path"), parent.alias("parent_path"), name.alias("name"),
            F.lit(kind).alias("node_kind"), key_list.alias("keys"), type_info.alias("type_info"), F.concat(F.lit("about "), name).alias("description"),
        )

    r = F.concat(F.lit("/r"), F.col("n_regionkey").cast("string"))
    n = F.concat(r, F.lit("/n"), F.col("n_nationkey").cast("string"))
    nc = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    c = F.concat(n, F.lit("/c"), F.col("c_custkey").cast("string"))
    regions = t.region.withColumnRenamed("r_regionkey", "n_regionkey")
    none = F.lit(None).cast("string")
    return tree.with_ids(
        union_all(
            [
                level(regions, r, none, F.col("r_name"), "container", keys(), info("empty")),
                level(t.nation, n, r, F.col("n_name"), "list", keys("id", "zone"), info("empty")),
                level(t.nation, F.concat(n, F.lit("/id")), n, F.lit("id"), "leaf", keys(), info("int16", 1, 500)),
                level(nc, c, n, F.col("c_name"), "leaf", keys(), info("uint8")),
            ]
        )
    )


_T = """WITH n AS (SELECT '/r'||r_regionkey AS p, NULL AS pp, r_name AS name, 'container' AS kind FROM region UNION ALL
 SELECT '/r'||n_regionkey||'/n'||n_nationkey, '/r'||n_regionkey, n_name, 'list' FROM nation UNION ALL
 SELECT '/r'||n_regionkey||'/n'||n_nationkey||'/id', '/r'||n_regionkey||'/n'||n_nationkey, 'id', 'leaf' FROM nation UNION ALL
 SELECT '/r'||n_regionkey||'/n'||n_nationkey||'/c'||c_custkey, '/r'||n_regionkey||'/n'||n_nationkey, c_name, 'leaf' FROM customer JOIN nation ON c_nationkey=n_nationkey),
 i AS (SELECT *, 'base:'||substr(sha256(p),1,12) AS id FROM n)
"""


@register("tree_parents", _T + "SELECT a.p AS schema_path, a.id AS node_id, b.id AS parent_id FROM i a LEFT JOIN i b ON b.p=a.pp")
def tree_parents(t):
    return tree_nodes(t).select("schema_path", "node_id", "parent_id")


@register(
    "tree_ancestors",
    _T
    + "SELECT a.id AS target_id, b.id AS node_id, (len(string_split(b.p,'/'))-2)::INTEGER AS depth FROM i a JOIN i b ON starts_with(a.p, b.p||'/')",
)
def tree_ancestors(t):
    n = tree_nodes(t)
    return tree.ancestors(n, n).select("target_id", "node_id", "depth")


@register("tree_children", _T + "SELECT b.id AS parent_id, a.id AS child_id FROM i a JOIN i b ON b.p=a.pp")
def tree_children(t):
    return tree.children(tree_nodes(t))


@register("tree_roots", _T + "SELECT id AS node_id, p AS schema_path FROM i WHERE pp IS NULL")
def tree_roots(t):
    return tree.roots(tree_nodes(t), "base").select("node_id", "schema_path")


@register(
    "required_keys",
    _T
    + """SELECT a.id AS target_id, l.p AS list_path, k AS key_name, CASE WHEN k='id' THEN 'int16' ELSE 'string' END AS type
    FROM i a JOIN i l ON l.kind='list' AND (a.p=l.p OR starts_with(a.p, l.p||'/')), (SELECT unnest(['id','zone']) AS k)""",
)
def required_keys(t):
    n = tree_nodes(t)
    return tree.required_keys(n, n).select("target_id", "list_path", "key_name", "type")


@register(
    "instance_paths",
    _T
    + """, c AS (SELECT id, p, name, split_part(p,'/',4)[2:]::BIGINT AS k, pp FROM i WHERE p LIKE '/r%/n%/c%')
    SELECT c.id AS node_id, CASE WHEN k%3=0 THEN NULL ELSE '/b:' || r.name || '/' || l.name || '[id=''' || k || '''][zone=''z'']/' || c.name END AS instance_path,
    CASE WHEN k%3=0 THEN 'zone' ELSE '' END AS missing FROM c JOIN i l ON l.p=c.pp JOIN i r ON r.p=l.pp""",
)
def instance_paths(t):
    n = tree_nodes(t)
    k = F.regexp_extract("schema_path", "/c(\\d+)$", 1)
    targets = n.filter(k != "").withColumn(
        "key_values",
        F.when(k.cast("long") % 3 == 0, F.create_map(F.lit("id"), k)).otherwise(F.create_map(F.lit("id"), k, F.lit("zone"), F.lit("z"))),
    )
    return tree.instance_paths(targets, n, F.lit("b")).select("node_id", "instance_path", F.array_join("missing_keys", ",").alias("missing"))


@register("tree_search", _T + "SELECT id AS node_id, p AS schema_path FROM i WHERE kind='leaf' AND contains(lower(name),'7') ORDER BY p LIMIT 10")
def tree_search(t):
    # the digit also stands in paths, which the search looks at as well
    n = tree_nodes(t).withColumn("schema_path2", F.col("schema_path"))
    hits = tree.search(n.withColumn("schema_path", F.when(F.lower("name").contains("7"), F.col("schema_path")).otherwise("/none")).withColumn("description", F.lit("")), "7", "leaf")
    return hits.select("node_id", F.col("schema_path2").alias("schema_path"))


@register("find_leaf", _T + "SELECT id AS node_id, p AS schema_path FROM i WHERE name='id' AND contains(p,'/r1/')")
def find_leaf(t):
    return tree.find_leaf(tree_nodes(t), "ID", "/R1/").select("node_id", "schema_path")


@register("tree_modules", "SELECT DISTINCT p_brand AS module FROM part")
def tree_modules(t):
    return tree.modules(t.part.select(F.col("p_brand").alias("module")))


@register(
    "validate_values",
    """SELECT l_orderkey, l_linenumber, l_extendedprice AS x, CASE (l_orderkey+l_linenumber)%4 WHEN 0 THEN l_quantity BETWEEN 1 AND 10 OR l_quantity BETWEEN 20 AND 30
       WHEN 1 THEN l_suppkey<=255 WHEN 2 THEN l_returnflag='N' OR l_returnflag='A' ELSE l_linestatus='O' END AS valid FROM lineitem""",
)
def validate_values(t):
    kind = (F.col("l_orderkey") + F.col("l_linenumber")) % 4
    r = lambda a, b: F.struct(F.lit(a).cast("long").alias("min"), F.lit(b).cast("long").alias("max"))
    no_range = F.array().cast("array<struct<min:bigint,max:bigint>>")
    info = F.struct(
        F.when(kind == 0, "int32").when(kind == 1, "uint8").when(kind == 2, "string").otherwise("enumeration").alias("base"),
        F.when(kind == 0, F.array(r(1, 10), r(20, 30))).otherwise(no_range).alias("range"),
        F.array(F.lit("[A-Z]"), F.lit("[NA]")).alias("pattern"),
        F.array(F.lit("O"), F.lit("P")).alias("enum"),
    )
    value = (
        F.when(kind == 0, F.col("l_quantity").cast("long").cast("string")).when(kind == 1, F.col("l_suppkey").cast("string"))
        .when(kind == 2, F.col("l_returnflag")).otherwise(F.col("l_linestatus"))
    )
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("x"), value.alias("v"), info.alias("i"))
    return rows.select("l_orderkey", "l_linenumber", "x", tree.validation_error(F.col("v"), F.col("i")).isNull().alias("valid"))


@register(
    "validate_nodes",
    _T
    + "SELECT o_orderkey, CASE WHEN i.id IS NULL THEN 'node not found' WHEN o_custkey>255 THEN 'out of native range' END AS error FROM orders LEFT JOIN i ON i.p LIKE '%/c'||o_custkey AND o_custkey%10<>0",
)
def validate_nodes(t):
    n = tree_nodes(t)
    cust = n.select("node_id", F.regexp_extract("schema_path", "/c(\\d+)$", 1).alias("c")).filter(F.col("c") != "")
    v = t.orders.join(cust, F.col("o_custkey").cast("string") == F.col("c"), "left").select(
        "o_orderkey", F.when(F.col("o_custkey") % 10 == 0, "base:none").otherwise(F.coalesce("node_id", F.lit("base:none"))).alias("node_id"), F.col("o_custkey").cast("string").alias("value")
    )
    return tree.validate(v, n).select("o_orderkey", "error")


def triples(t):
    """Order lines as triples: supplier delivers part, some of them unusable."""
    li = t.lineitem
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"),
        F.when(F.col("l_orderkey") % 97 != 0, _id("S", "l_suppkey")).alias("subject"),
        F.when(F.col("l_linenumber") % 2 == 0, " DELIVERS ").otherwise("").alias("predicate"),
        F.when(F.col("l_partkey") % 31 == 0, " N/A ").otherwise(_id("P", "l_partkey")).alias("object"),
        F.lit("supplier").alias("subject_label"),
        F.lit("part").alias("object_label"),
        F.lit(None).cast("string").alias("subject_node_key"),
        F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("K"), F.col("l_partkey").cast("string"))).alias("object_node_key"),
        F.create_map(F.lit("flag"), F.col("l_returnflag"), F.concat(F.lit("s"), F.col("l_linestatus")), F.lit("1")).alias("subject_properties"),
        F.create_map(F.lit("qty"), F.col("l_quantity").cast("long").cast("string")).alias("object_properties"),
        F.lit("{}").alias("meta"),
        F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 9, "0"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lpad("l_partkey", 9, "0"), F.lpad("l_suppkey", 9, "0"), F.lpad(F.col("l_extendedprice").cast("string"), 12, "0"), F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_quantity").cast("string")).alias("line"),
    )


_TR = """WITH t AS (SELECT CASE WHEN l_orderkey%97<>0 THEN 'S'||l_suppkey END AS s, CASE WHEN l_linenumber%2=0 THEN 'DELIVERS' ELSE 'HAS_TRIPLE' END AS pr,
 CASE WHEN l_partkey%31<>0 THEN 'P'||l_partkey END AS o, CASE WHEN l_partkey%2=0 THEN 'K'||l_partkey ELSE 'P'||l_partkey END AS ok, l_returnflag, l_linestatus, l_quantity::BIGINT AS q,
 lpad(l_orderkey::VARCHAR,9,'0') || '-' || lpad(l_linenumber::VARCHAR,2,'0') || '-' || lpad(l_partkey::VARCHAR,9,'0') || '-' || lpad(l_suppkey::VARCHAR,9,'0') || '-' ||
 lpad(l_extendedprice::VARCHAR,12,'0') || '-' || l_returnflag || '-' || l_linestatus || '-' || l_quantity::VARCHAR AS line FROM lineitem),
 g AS (SELECT * FROM t WHERE s IS NOT NULL AND o IS NOT NULL)
"""


@register(
    "triple_rejects",
    _TR + "SELECT CASE WHEN s IS NULL THEN 'missing subject or predicate' ELSE 'object is null-like' END AS reason, count(*) AS n FROM t WHERE s IS NULL OR o IS NULL GROUP BY 1",
)
def triple_rejects(t):
    return ontology.clean_triples(triples(t))[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@register(
    "triple_nodes",
    _TR
    + """SELECT 'supplier' AS label, s AS node_key, s AS name, 'flag=' || arg_max(l_returnflag, line) || CASE WHEN bool_or(l_linestatus='F') THEN ',sF=1' ELSE '' END
    || CASE WHEN bool_or(l_linestatus='O') THEN ',sO=1' ELSE '' END AS props FROM g GROUP BY s
    UNION ALL SELECT 'part', ok, o, 'qty=' || arg_max(q, line) FROM g GROUP BY ok, o""",
)
def triple_nodes(t):
    n = ontology.graph_nodes(ontology.clean_triples(triples(t))[0])
    text = F.array_join(F.transform(F.map_entries("properties"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return n.select("label", "node_key", "name", text.alias("props"))


@register(
    "triple_edges",
    _TR + "SELECT s AS from_key, pr AS predicate, ok AS to_key, '{}' AS meta, max(line) AS source_line FROM g GROUP BY 1,2,3",
)
def triple_edges(t):
    return ontology.graph_edges(ontology.clean_triples(triples(t))[0])


@register(
    "provenance",
    "SELECT l_suppkey, count(DISTINCT l_partkey) AS chunks FROM lineitem GROUP BY 1",
)
def provenance(t):
    p = ontology.provenance(t.lineitem.select("l_suppkey", F.col("l_partkey").alias("chunk_id")), ["l_suppkey"])
    return p.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("chunks"))


@register(
    "additive_merge",
    """WITH v AS (SELECT p_brand AS name, p_type AS v, min(p_partkey) AS k FROM part GROUP BY 1,2)
       SELECT name, 'type' AS property, string_agg(v, ' | ' ORDER BY k) AS value FROM v GROUP BY 1
       UNION ALL SELECT p_brand, 'kind', 'part' FROM part GROUP BY 1""",
)
def additive_merge(t):
    rows = t.part.select(
        F.col("p_brand").alias("name"), "p_partkey", F.create_map(F.lit("type"), F.col("p_type"), F.lit("kind"), F.lit("part")).alias("properties")
    )
    return ontology.merge_properties(rows, ["name"], ["p_partkey"])


@register(
    "merge_descriptions",
    """WITH v AS (SELECT p_type AS name, '<' || p_brand || '>' AS v, min(p_partkey) AS k FROM part GROUP BY 1,2)
       SELECT name, string_agg(v, ' / ' ORDER BY k) AS description FROM v GROUP BY 1""",
)
def merge_descriptions(t):
    rows = t.part.select(F.col("p_type").alias("name"), "p_partkey", F.concat(F.lit("<"), F.col("p_brand"), F.lit(">")).alias("description"))
    return ontology.merge_descriptions(rows, ["name"], ["p_partkey"])


@register(
    "ontology_filter",
    _N + "SELECT id, node_type FROM n WHERE node_type IN ('feature','function','kpi') AND name IS NOT NULL",
)
def ontology_filter(t):
    return ontology.valid_nodes(nodes(t).withColumn("label", F.col("node_type")), ["feature", "function", "kpi"]).select("id", "node_type")


@register(
    "relation_cleaning",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'RELATED_TO' ELSE upper(event_type) || '_OF_IT' END AS relation, replace('a '||event_type,' ','_') AS label,
       'key1_=' || user_id AS props FROM events""",
)
def relation_cleaning(t):
    rel = F.when(F.col("event_type") != "view", F.concat(F.col("event_type"), F.lit("-of it")))
    props = ontology.clean_properties(F.create_map(F.lit("key-1_!"), F.col("user_id").cast("string"), F.lit(""), F.lit("x")))
    return t.events.select(
        "event_id", ontology.clean_relation(rel).alias("relation"), ontology.clean_label(F.concat(F.lit("a "), F.col("event_type"))).alias("label"),
        F.array_join(F.transform(F.map_entries(props), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("props"),
    )


@register(
    "relation_types",
    "SELECT event_id, upper(event_type) AS type FROM events WHERE event_type IN ('click','view')",
)
def relation_types(t):
    return ontology.valid_relations(t.events.select("event_id", F.col("event_type").alias("type")), ["CLICK", "VIEW"])


def hierarchy_source(t):
    """One nested document per customer: its nation as function, its segment as feature."""
    key = F.col("c_custkey").cast("string")
    feature = F.struct(
        F.concat(F.lit("F"), key).alias("id"), F.col("c_mktsegment").alias("name"),
        F.when(F.col("c_custkey") % 2 == 0, "MAC").alias("layer"), F.array("c_mktsegment").alias("kpis"),
    )
    function = F.struct(
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string"), F.lit("-"), key).alias("id"), F.lit("fn").alias("name"),
        F.array(F.lit("kpi:all")).alias("kpis"), F.array(feature).alias("features"),
    )
    doc = F.to_json(F.struct(_id("C", "c_custkey").alias("id"), F.col("c_name").alias("name"), F.array(function).alias("functions")))
    schema = "id string, name string, functions array<struct<id:string,name:string,kpis:array<string>,features:array<struct<id:string,name:string,layer:string,kpis:array<string>>>>>"
    return t.customer.select(F.from_json(doc, schema).alias("g")).select("g.*")


@register(
    "hierarchy_edges",
    """SELECT 'C'||c_custkey AS from_id, 'N'||c_nationkey||'-'||c_custkey AS to_id, 'INCLUDES' AS relation FROM customer UNION ALL
       SELECT 'N'||c_nationkey||'-'||c_custkey, 'F'||c_custkey, 'REALIZED_BY' FROM customer UNION ALL SELECT 'N'||c_nationkey||'-'||c_custkey, 'kpi:all', 'MEASURED_BY' FROM customer UNION ALL
       SELECT 'F'||c_custkey, c_mktsegment, 'MEASURED_BY' FROM customer UNION ALL SELECT 'F'||c_custkey, 'MAC', 'IMPLEMENTED_IN' FROM customer WHERE c_custkey%2=0""",
)
def hierarchy_edges(t):
    return ontology.hierarchy(hierarchy_source(t))[1]


@register(
    "hierarchy_nodes",
    """SELECT 'C'||c_custkey AS id, c_name AS name, 'control_group' AS node_type FROM customer UNION ALL SELECT 'N'||c_nationkey||'-'||c_custkey, 'fn', 'function' FROM customer UNION ALL
       SELECT 'F'||c_custkey, c_mktsegment, 'feature' FROM customer UNION ALL SELECT DISTINCT c_mktsegment, c_mktsegment, 'kpi' FROM customer UNION ALL SELECT 'kpi:all','kpi:all','kpi'""",
)
def hierarchy_nodes(t):
    return ontology.hierarchy(hierarchy_source(t))[0].select("id", "name", "node_type")


def attempts(t):
    """Events as step results: id by type, a repeated attempt number, the event as arrival order."""
    e = t.events
    return e.select(
        F.col("user_id").alias("run"), F.col("event_type").alias("id"), (F.col("event_id") % 5).alias("attempt"),
        F.col("event_id").alias("seq"), (F.col("value") > 20).alias("verdict"), "value",
    )


@register(
    "merge_attempts",
    "SELECT user_id AS run, event_type AS id, event_id%5 AS attempt, arg_max(value,event_id) AS value, min(event_id) AS position FROM events GROUP BY 1,2,3",
)
def merge_attempts(t):
    return review.merge_attempts(attempts(t), ["run"], "seq").select("run", "id", "attempt", "value", "position")


@register(
    "latest_successful",
    """WITH m AS (SELECT user_id AS run, event_type AS id, event_id%5 AS attempt, arg_max(value,event_id) AS value FROM events GROUP BY 1,2,3)
       SELECT run, id, max(attempt) AS attempt, arg_max(value, attempt) AS value FROM m WHERE value>20 AND id<>'view' GROUP BY 1,2""",
)
def latest_successful(t):
    merged = review.merge_attempts(attempts(t), ["run"], "seq")
    return review.latest_successful(merged, ["run"], "view").select("run", "id", "attempt", "value")


@register(
    "merge_by_id",
    "SELECT user_id AS run, event_type AS id, min(event_id) AS seq, arg_min(value,event_id) AS value FROM events WHERE event_type<>'error' GROUP BY 1,2",
)
def merge_by_id(t):
    rows = attempts(t).withColumn("id", F.when(F.col("id") != "error", F.col("id")))
    return review.merge_by_id(rows.select("run", "id", "seq", "value"), ["run"], "id", "seq")


@register(
    "merge_history",
    "SELECT conv_id, turn%3 AS subtask_id, min(turn) AS seq FROM conversations GROUP BY conv_id, turn%3, substr(text,1,100)",
)
def merge_history(t):
    rows = t.conversations.select("conv_id", (F.col("turn") % 3).alias("subtask_id"), F.col("text").alias("query"), F.col("turn").alias("seq"))
    return review.merge_history(rows, ["conv_id"], "seq").select("conv_id", "subtask_id", "seq")


@register(
    "features_in_order",
    "SELECT user_id AS run, event_type AS feature_id, arg_min(props,event_id) AS feature_name, min(event_id) AS first_seen FROM events GROUP BY 1,2",
)
def features_in_order(t):
    rows = t.events.select(F.col("user_id").alias("run"), F.concat(F.lit(" "), F.col("event_type")).alias("feature_id"), F.col("props").alias("feature_name"), F.col("event_id").alias("pos"))
    out = review.features_in_order(rows, ["run"], ["pos"])
    return out.select("run", "feature_id", "feature_name", F.col("position.pos").alias("first_seen"))
