"""Ontologies and triples: cleaning, additive merging, graph building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass import fixed_values as fixed
from fieldglass.functions.text import strip
from fieldglass.operators.predicates import null_like


def clean_label(label: Column) -> Column:
    return F.replace(F.coalesce(label, F.lit("Entity")), F.lit(" "), F.lit("_"))


def clean_relation(relation: Column) -> Column:
    return F.translate(F.upper(F.coalesce(relation, F.lit(fixed.DEFAULT_RELATION))), " -", "__")


def clean_properties(properties: Column) -> Column:
    """Keys reduced to letters, digits and underscore; empty keys dropped."""
    keyed = F.map_filter(properties, lambda k, _: F.length(k) > 0)
    entries = F.transform(
        F.map_entries(keyed),
        lambda e: F.struct(F.regexp_replace(e["key"], r"[^\p{L}\p{N}_]", "").alias("key"), e["value"].alias("value")),
    )
    # two keys may become equal: the later one wins
    last = F.filter(
        F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), i.alias("i"))),
        lambda e: ~F.exists(F.slice(entries, e["i"] + 2, F.size(entries)), lambda o: o["key"] == e["key"]),
    )
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def valid_nodes(nodes: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Nodes whose type (or label, when it has none) is one of the base types."""
    kind = F.coalesce(F.nullif(F.col("node_type"), F.lit("")), F.col("label"))
    return nodes.filter(kind.isin(types or fixed.NODE_TYPES))


def valid_relations(relations: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Upper-cased relation types with a default, kept when in the list (any type without a list)."""
    named = relations.withColumn("type", F.upper(F.coalesce(F.nullif(F.col("type"), F.lit("")), F.lit(fixed.DEFAULT_RELATION))))
    return named.filter(F.col("type").isin(types)) if types else named


def _fold(values: Column, separator: str) -> Column:
    """Join values in order, leaving out those the text so far contains."""
    return F.aggregate(
        F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))),
        F.get(values, F.lit(0)),
        lambda acc, v: F.when(acc.contains(v), acc).otherwise(F.concat(acc, F.lit(separator), v)),
    )


def merge_properties(rows: DataFrame, keys: list[str], order: list[str], properties: str = "properties") -> DataFrame:
    """Additive merge of property maps per key: ``(keys, property, value)``.

    Equal values combine before the ordered fold (a value that was merged once
    is contained from then on), so the fold sees distinct values only.
    """
    entries = rows.select(*keys, *order, F.explode(properties).alias("property", "value")).withColumn(
        "value", F.col("value").cast("string")
    )
    first = entries.groupBy(*keys, "property", "value").agg(F.min(F.struct(*order)).alias("at"))
    folded = first.groupBy(*keys, "property").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("v"))
    return folded.select(*keys, "property", _fold(F.transform("v", lambda s: s["value"]), " | ").alias("value"))


def merge_descriptions(rows: DataFrame, keys: list[str], order: list[str], column: str = "description") -> DataFrame:
    """Descriptions joined by `` / `` in order of first appearance; a missing first one counts as empty."""
    text = F.coalesce(F.col(column), F.lit(""))
    first = rows.select(*keys, *order, text.alias("d")).groupBy(*keys, "d").agg(F.min(F.struct(*order)).alias("at"))
    grouped = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "d"))).alias("v"))
    parts = F.transform("v", lambda s: s["d"])
    wanted = F.filter(parts, lambda d, i: (i == 0) | (d != ""))
    return grouped.select(*keys, _fold(wanted, " / ").alias(column))


def provenance(mentions: DataFrame, node: list[str], chunk: str = "chunk_id") -> DataFrame:
    """Distinct chunks of each node as rows; a node may come from any number of chunks."""
    return mentions.filter(F.col(chunk).isNotNull()).select(*node, chunk).distinct()


def clean_triples(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable triples and rejected ones with the reason."""
    reason = (
        F.when(F.col("subject").isNull() | F.col("predicate").isNull(), "missing subject or predicate")
        .when(null_like(F.col("object")), "object is null-like")
    )
    marked = triples.withColumn("reason", reason)
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())


def stringify(value: Column) -> Column:
    """JSON text of anything that is not a string."""
    wrapped = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


def node_key(value: Column, explicit: Column) -> Column:
    return F.coalesce(explicit.cast("string"), value)


def graph_nodes(triples: DataFrame) -> DataFrame:
    """One node per (label, key, name); per property the value of the last line wins.

    Both ends of a triple come from one scan, one row for each. The properties of the last line are kept for each
    set of names that a node's properties have, and are then resolved one by one before they are
    put together again, so a node that stands in a large share of all triples is never gathered;
    a nameless property stands for the bare node.
    """
    end = lambda p, side: F.struct(
        F.coalesce(F.col(f"{p}_label"), F.lit("")).alias("label"),
        node_key(F.col(p), F.col(f"{p}_node_key")).alias("node_key"),
        F.col(p).alias("name"),
        F.map_entries(F.coalesce(F.col(f"{p}_properties"), F.create_map().cast("map<string,string>"))).alias("held"),
        F.struct("line", F.lit(side).alias("side")).alias("at"),
    )
    ends = triples.select(F.inline(F.array(end("subject", 0), end("object", 1))))
    keys = ["label", "node_key", "name"]
    alike = ends.groupBy(*keys, F.col("held.key").alias("names")).agg(F.max_by(F.struct("at", "held"), "at").alias("s"))
    bare = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value")))
    each = alike.select(*keys, F.col("s.at").alias("at"), F.explode(F.concat("s.held", bare)).alias("p"))
    last = each.select(*keys, "at", "p.key", "p.value").groupBy(*keys, "key").agg(F.max_by("value", "at").alias("v"))
    named = F.when(F.col("key").isNotNull(), F.struct(F.col("key").alias("k"), "v"))  # lists leave nulls out
    return last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(named))).alias("properties"))


def graph_edges(triples: DataFrame) -> DataFrame:
    """One edge per (subject node, predicate, object node) with the meta and line of its last triple."""
    kind = F.coalesce(F.nullif(strip(F.col("predicate")), F.lit("")), F.lit("HAS_TRIPLE"))
    rows = triples.select(
        node_key(F.col("subject"), F.col("subject_node_key")).alias("from_key"),
        kind.alias("predicate"),
        node_key(F.col("object"), F.col("object_node_key")).alias("to_key"),
        "meta",
        "line",
    )
    return rows.groupBy("from_key", "predicate", "to_key").agg(
        F.max_by("meta", "line").alias("meta"), F.max("line").alias("source_line")
    )


def hierarchy(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nested control groups -> functions -> features and KPIs as node and edge tables.

    ``groups``: id, name, functions array<struct<id, name, kpis, features array<struct<id, name, layer, kpis>>>>.
    """
    f = groups.select(F.col("id").alias("gid"), F.explode("functions").alias("f"))
    x = f.select(F.col("f.id").alias("fid"), F.explode("f.features").alias("x"))
    node = lambda df, i, n, t, layer=F.lit(None).cast("string"): df.select(
        i.alias("id"), n.alias("name"), F.lit(t).alias("node_type"), layer.alias("layer")
    )
    fk = f.select(F.col("f.id").alias("from_id"), F.explode("f.kpis").alias("to_id"))
    xk = x.select(F.col("x.id").alias("from_id"), F.explode("x.kpis").alias("to_id"))
    kpis = fk.select("to_id").unionByName(xk.select("to_id")).distinct()
    col = F.col
    nodes = (
        node(groups, col("id"), col("name"), "control_group")
        .unionByName(node(f, col("f.id"), col("f.name"), "function"))
        .unionByName(node(x, col("x.id"), col("x.name"), "feature", col("x.layer")))
        .unionByName(node(kpis, col("to_id"), col("to_id"), "kpi"))
    )
    edge = lambda df, a, b, r: df.select(a.alias("from_id"), b.alias("to_id"), F.lit(r).alias("relation"))
    edges = (
        edge(f, col("gid"), col("f.id"), "INCLUDES")
        .unionByName(edge(x, col("fid"), col("x.id"), "REALIZED_BY"))
        .unionByName(edge(fk, col("from_id"), col("to_id"), "MEASURED_BY"))
        .unionByName(edge(xk, col("from_id"), col("to_id"), "MEASURED_BY"))
        .unionByName(edge(x.filter(col("x.layer").isNotNull()), col("x.id"), col("x.layer"), "IMPLEMENTED_IN"))
    )
    return nodes, edges.distinct()
