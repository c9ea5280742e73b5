"""Property graphs as node and edge tables: ``nodes(id, ...)``, ``edges(from_id, to_id, relation, ...)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.session import cut_lineage, union_all, write_down


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Ids within ``hops`` steps of the seeds, edges walked both ways: ``(id, hop)``.

    Only seeds that occur in the graph count. Each round joins the newest ids to
    the edges (a semi-join, so a hub's edges are filtered where they lie) and
    writes the new frontier down before the next one.
    """
    ends = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    both = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
    known = both.select(F.col("a").alias("id"))
    frontier = seeds.select("id").distinct().join(known, "id", "left_semi").withColumn("hop", F.lit(0))
    frontier = write_down(frontier)
    seen = frontier
    for hop in range(1, hops + 1):
        reached = both.join(frontier.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id"))
        fresh = reached.distinct().join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop))
        frontier = write_down(fresh)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in the node set."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(
        ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi"
    )


def subgraph(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int, generation: str | None = None):
    """Nodes and edges around the seeds, optionally of one generation only."""
    from fieldglass.operators.predicates import generation_filter

    near = nodes.join(neighbourhood(edges, seeds, hops), "id")
    if generation:
        near = near.filter(generation_filter("gen", generation))
    return near, induced_edges(edges, write_down(near.select("id").distinct()))


def successors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each edge with the attributes of the node it leads to."""
    return edges.join(nodes.withColumnRenamed("id", "to_id"), "to_id")


def out_edges(edges: DataFrame, node_id: str) -> DataFrame:
    return edges.filter(F.col("from_id") == node_id)


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count(F.lit(1)).alias("c")).scalar()
    return edges.agg(F.count(F.lit(1)).alias("edges")).select(n.alias("nodes"), "edges")


def bridge_keys(rows: DataFrame, document: str, row_id: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Key nodes and row-to-key links. Rows of different documents meet at their key node.

    A key shared by n rows costs n links, never n * n pairs. Null keys are not linked.
    """
    links = rows.filter(F.col(key).isNotNull()).select(document, row_id, F.col(key).cast("string").alias("key"))
    per_document = links.groupBy("key", document).agg(F.count(F.lit(1)).alias("r"))
    keys = per_document.groupBy("key").agg(F.sum("r").alias("rows"), F.count(F.lit(1)).alias("documents"))
    return keys, links


def simple_paths_to(edges: DataFrame, target, max_edges: int = 50) -> DataFrame:
    """All simple directed paths that end at ``target``: ``(source, path)``, longest ``max_edges``.

    Paths grow backwards from the target one edge per round; a finished round is
    written down, and the loop ends when no path can grow. Raises when the bound
    is met first, so a result is never cut short silently.
    """
    e = edges.select("from_id", "to_id").distinct().filter(F.col("from_id") != F.col("to_id"))
    target_type = e.schema["to_id"].dataType
    last = cut_lineage(
        e.filter(F.col("to_id") == F.lit(target)).select(
            F.col("from_id").alias("source"), F.array("from_id", "to_id").alias("path")
        )
    )
    found = [last]
    for _ in range(max_edges - 1):
        grown = (
            last.join(e, F.col("source") == F.col("to_id"))
            .filter(~F.array_contains("path", F.col("from_id")))
            .select(F.col("from_id").alias("source"), F.concat(F.array(F.col("from_id").cast(target_type)), F.col("path")).alias("path"))
        )
        last = cut_lineage(grown)
        if last.isEmpty():
            return union_all(found)
        found.append(last)
    raise ValueError(f"paths longer than {max_edges} edges exist; raise max_edges")


def unblocked(tasks: DataFrame) -> DataFrame:
    """Open items of ``(id, verdict, dependencies)`` whose dependencies are all done; an unknown one blocks."""
    done = F.coalesce(F.lower(F.col("verdict").cast("string")).isin("true", "exceeded"), F.lit(False))
    open_ = tasks.filter(~done)
    finished = tasks.filter(done).select(F.col("id").alias("dep")).distinct()
    blocked = (
        open_.select("id", F.explode("dependencies").alias("dep")).join(finished, "dep", "left_anti").select("id").distinct()
    )
    return open_.join(blocked, "id", "left_anti")


def transitions(docs: DataFrame, doc_id: str, text: str = "text") -> DataFrame:
    """State changes described in the sentences of each document: ``(from, to, context)``.

    The states of a document and the pairs of one sentence stay inside the row.
    """
    from fieldglass import fixed_values as fixed
    from fieldglass.functions.text import strip

    clean = F.replace(F.replace(F.col(text), F.lit("\\_"), F.lit("_")), F.lit("*"), F.lit(""))
    tokens = F.filter(
        F.regexp_extract_all(clean, F.lit(f"({fixed.STATE_TOKEN})"), 1),
        lambda s: F.length(s) >= fixed.STATE_MIN_LENGTH,
    )
    trimmed = F.transform(tokens, lambda s: F.regexp_replace(s, "^_+|_+$", ""))
    core = F.array_compact(F.array(*[F.when(clean.contains(s), F.lit(s)) for s in fixed.CORE_STATES]))
    states = F.array_sort(F.array_distinct(F.concat(trimmed, core)))
    sentences = docs.select(doc_id, states.alias("states"), F.posexplode(F.split(clean, fixed.SENTENCE_BREAK)).alias("pos", "raw"))
    lines = sentences.select(doc_id, "pos", "states", strip(F.col("raw")).alias("line")).filter(F.col("line") != "")
    lines = lines.withColumn("upper", F.upper("line"))
    lines = lines.withColumn("found", F.filter("states", lambda s: F.col("upper").contains(s)))
    cut = F.concat(F.substring("line", 1, fixed.CONTEXT_CHARS), F.when(F.length("line") > fixed.CONTEXT_CHARS, "...").otherwise(""))

    def linked(a: Column, b: Column) -> Column:
        forward = F.rlike(F.col("upper"), F.concat(a, F.lit(r".*?\bTO\b.*?"), b))
        backward = F.rlike(F.col("upper"), F.concat(b, F.lit(r".*?\bFROM\b.*?"), a))
        return (a != b) & (forward | backward)

    pairs = F.flatten(
        F.transform(
            "found",
            lambda a: F.transform(
                F.filter("found", lambda b: linked(a, b)), lambda b: F.struct(a.alias("from_state"), b.alias("to_state"))
            ),
        )
    )
    two = lines.filter(F.size("found") > 1).select(doc_id, "pos", F.explode(pairs).alias("p"), cut.alias("context"))
    two = two.select(doc_id, "pos", "p.from_state", "p.to_state", "context")
    only = F.get(F.col("found"), F.lit(0))
    verb = F.col("upper").rlike("|".join(v.upper() for v in fixed.TRANSITION_VERBS))
    entering = F.rlike(F.col("line"), F.concat(F.lit(r"(?i)(?:transition|enter|move|go)\s+(?:to\s+)?"), only))
    one = lines.filter((F.size("found") == 1) & verb & entering).select(
        doc_id, "pos", F.lit("OTHER/ANY").alias("from_state"), only.alias("to_state"),
        F.substring("line", 1, fixed.CONTEXT_CHARS).alias("context"),
    )
    return two.unionByName(one)
