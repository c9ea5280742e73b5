"""Schema trees as one node table: ``node_id, schema_path, name, module, node_kind, parent_id, keys, type_info``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass import fixed_values as fixed
from fieldglass.functions.text import node_id


def with_ids(raw: DataFrame) -> DataFrame:
    """Stable ids from module and path; the parent is the node at the parent path, if that exists.

    A path that several modules define belongs to the node's own module, else to the last one by name.
    """
    nodes = raw.withColumn("node_id", node_id(F.col("module"), F.col("schema_path")))
    own = nodes.select("module", F.col("schema_path").alias("parent_path"), F.col("node_id").alias("_own")).dropDuplicates(["module", "parent_path"])
    any_ = nodes.groupBy(F.col("schema_path").alias("parent_path")).agg(F.max_by("node_id", "module").alias("_any"))
    joined = nodes.join(own, ["module", "parent_path"], "left").join(any_, "parent_path", "left")
    return joined.withColumn("parent_id", F.coalesce("_own", "_any")).drop("_own", "_any")


def _one_per_path(rows: DataFrame, nodes: DataFrame, path: str) -> DataFrame:
    """``rows`` joined with one node per ``path``: that of the row's ``_module``, else the last module's."""
    rest = [c for c in nodes.columns if c != "schema_path"]
    held = nodes.select(F.col("schema_path").alias(path), F.struct(*rest).alias("_node"))
    own = held.withColumn("_module", F.col("_node.module")).groupBy(path, "_module").agg(F.min_by("_node", "_node.node_id").alias("_own"))
    last = held.groupBy(path).agg(F.max_by("_node", F.struct("_node.module", "_node.node_id")).alias("_any"))
    found = rows.join(own, [path, "_module"], "left").join(last, path, "left")
    return found.withColumn("_node", F.coalesce("_own", "_any")).drop("_own", "_any")


def children(nodes: DataFrame) -> DataFrame:
    """Parent and child ids as rows, so that a parent may have any number of children."""
    return nodes.filter(F.col("parent_id").isNotNull()).select("parent_id", F.col("node_id").alias("child_id"))


def roots(nodes: DataFrame, module: str) -> DataFrame:
    return nodes.filter((F.col("module") == module) & F.col("parent_id").isNull()).orderBy("schema_path")


def _prefixes(path: Column) -> Column:
    """``/a/b/c`` -> ``[/a, /a/b, /a/b/c]``."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
    )


def path_nodes(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every node on the way from the root to each target, the target included.

    Depth comes from the path text, so all levels are found in one equi-join
    instead of one join per level. ``(target_id, depth)`` plus the node's columns.
    """
    steps = targets.select(
        F.col("node_id").alias("target_id"), F.col("module").alias("_module"), F.posexplode(_prefixes(F.col("schema_path"))).alias("depth", "schema_path")
    )
    found = _one_per_path(steps, nodes, "schema_path").filter(F.col("_node").isNotNull())
    return found.select("schema_path", "target_id", "depth", "_node.*")


def ancestors(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    return path_nodes(targets, nodes).filter(F.col("node_id") != F.col("target_id"))


def required_keys(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Keys of every list on the path with the type of their leaf; no leaf means string."""
    lists = path_nodes(targets, nodes).filter(F.col("node_kind") == "list")
    keys = lists.select(
        "target_id", "depth", F.col("module").alias("_module"), F.col("schema_path").alias("list_path"), F.posexplode("keys").alias("key_pos", "key_name")
    ).withColumn("leaf_path", F.concat_ws("/", "list_path", "key_name"))
    typed = _one_per_path(keys, nodes, "leaf_path").withColumn("_base", F.col("_node.type_info.base"))
    return typed.select(
        "target_id", "depth", "list_path", "key_pos", "key_name", F.coalesce("_base", F.lit("string")).alias("type")
    )


def instance_paths(targets: DataFrame, nodes: DataFrame, prefix: Column) -> DataFrame:
    """Instance path of each target from its ``key_values`` map, or the names of the missing keys."""
    values = targets.select(F.col("node_id").alias("target_id"), F.col("key_values").alias("_kv"))
    steps = path_nodes(targets, nodes).join(values, "target_id")
    key_list = F.when(F.col("node_kind") == "list", F.coalesce("keys", F.array().cast("array<string>"))).otherwise(
        F.array().cast("array<string>")
    )
    missing = F.filter(key_list, lambda k: ~F.map_contains_key("_kv", k))
    predicates = F.array_join(
        F.transform(key_list, lambda k: F.concat(F.lit("["), k, F.lit("='"), F.element_at("_kv", k), F.lit("']"))), ""
    )
    per_step = steps.select(
        "target_id",
        "depth",
        missing.alias("missing"),
        F.when(F.size(missing) == 0, F.concat(F.col("name"), predicates)).otherwise(F.col("name")).alias("segment"),
        prefix.alias("prefix"),
    )
    # as many rows per target as the tree is deep
    grouped = per_step.groupBy("target_id").agg(
        F.array_sort(F.collect_list(F.struct("depth", "segment", "missing", "prefix"))).alias("s")
    )
    lacking = F.flatten(F.transform("s", lambda x: x.missing))
    path = F.concat(
        F.lit("/"), F.get(F.col("s"), F.lit(0)).prefix, F.lit(":"), F.array_join(F.transform("s", lambda x: x.segment), "/")
    )
    return grouped.select(
        F.col("target_id").alias("node_id"),
        F.when(F.size(lacking) == 0, path).alias("instance_path"),
        lacking.alias("missing_keys"),
    )


def search(nodes: DataFrame, keyword: str, kind: str | None = None, top_k: int = 10) -> DataFrame:
    """Nodes naming the keyword in name, description or path, first ``top_k`` by path."""
    word = keyword.lower()
    hit = (
        F.lower("name").contains(word)
        | F.lower(F.coalesce("description", F.lit(""))).contains(word)
        | F.lower("schema_path").contains(word)
    )
    found = nodes.filter(hit)
    if kind:
        found = found.filter(F.col("node_kind") == kind)
    return found.orderBy("schema_path", "node_id").limit(top_k)


def find_leaf(nodes: DataFrame, name: str, parent_hint: str | None = None) -> DataFrame:
    """Leaves of a name; those under the hinted parent when there are any."""
    leaves = nodes.filter((F.lower("name") == name.lower()) & F.col("node_kind").isin("leaf", "leaf-list"))
    if parent_hint:
        hinted = leaves.filter(F.lower("schema_path").contains(parent_hint.lower()))
        any_hinted = hinted.agg((F.count(F.lit(1)) > 0).alias("h")).scalar()
        leaves = leaves.filter(~any_hinted | F.lower("schema_path").contains(parent_hint.lower()))
    return leaves


def modules(nodes: DataFrame) -> DataFrame:
    return nodes.select("module").distinct().orderBy("module")


def identity_candidates(nodes: DataFrame, type_name: str) -> DataFrame:
    return nodes.filter(
        (F.col("type_info.base") == "identityref") & F.lower("schema_path").contains(type_name.lower())
    )


def validation_error(value: Column, type_info: Column) -> Column:
    """Reason a value does not fit its type, null when it does.

    ``type_info``: struct(base, range array<struct<min,max>>, pattern array, enum array).
    """
    base = F.coalesce(type_info["base"], F.lit("string"))
    whole = F.when(F.trim(value).rlike(r"^[+-]?\d+$"), F.trim(value).try_cast("decimal(38,0)"))
    ranges = type_info["range"]
    in_ranges = F.exists(
        ranges, lambda r: (whole >= r["min"].cast("decimal(38,0)")) & (whole <= r["max"].cast("decimal(38,0)"))
    )
    native = F.coalesce(
        *[F.when(base == t, whole.between(F.lit(lo).cast("decimal(38,0)"), F.lit(hi).cast("decimal(38,0)"))) for t, (lo, hi) in (
            (t, (str(lo), str(hi))) for t, (lo, hi) in fixed.INTEGER_RANGES.items()
        )]
    )
    has_ranges = F.coalesce(F.size(ranges), F.lit(0)) > 0
    integer = (
        F.when(whole.isNull(), "not an integer")
        .when(has_ranges & ~in_ranges, "out of range")
        .when(~has_ranges & ~native, "out of native range")
    )
    patterns = F.coalesce(type_info["pattern"], F.array().cast("array<string>"))
    full = lambda p: F.rlike(value, F.concat(F.lit("^(?:"), p, F.lit(")\\z")))
    return (
        F.when(base.isin(*fixed.INTEGER_RANGES), integer)
        .when(base == "boolean", F.when(~value.isin("true", "false"), "not a boolean"))
        .when(base == "string", F.when(~F.forall(patterns, full), "pattern mismatch"))
        .when(base == "enumeration", F.when(~F.array_contains(type_info["enum"], value), "not in enumeration"))
    )


def validate(values: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node_id, value)`` against the node's type; an unknown node is invalid."""
    typed = values.join(nodes.select("node_id", "type_info", F.lit(True).alias("_known")), "node_id", "left")
    error = F.when(F.col("_known").isNull(), "node not found").otherwise(validation_error(F.col("value"), F.col("type_info")))
    return typed.select(*values.columns, error.isNull().alias("valid"), error.alias("error"))
