"""Walks over the lineage graph and audits of dependency graphs.

Both go round by round over written frames. The edges are laid out once, by the node they are entered from, and stay where
they lie; a round moves its frontier and writes only what is new: the nodes a walk reaches first, or the counters that an
audit lowers. A lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from brightwell.functions.values import count_when
from brightwell.plans.lineage_cut import cut_and_count, cut_lineage
from brightwell.plans.rounds import Layers, parts_for, settled_plans

#: Edges of a part, and edges of one node that lie in one place; a node with more is split.
PART_EDGES, HUB_EDGES = 100_000, 200_000
# Fixed value: the depth of a walk whose depth is zero or less.
DEFAULT_DEPTH = 1


def walk_depth(depth: int | None) -> int | None:
    """None walks to the end of the graph; a caller that wants a bound passes it."""
    return depth if depth is None or depth > 0 else DEFAULT_DEPTH


def table_edges(lineage: DataFrame) -> DataFrame:
    """Distinct table edges with both ends known; of several types the first in order is kept."""
    return lineage.filter(F.col("source_table").isNotNull() & F.col("target_table").isNotNull()).groupBy(
        "source_table", "target_table").agg(F.min("lineage_type").alias("lineage_type"))


def column_links(lineage: DataFrame) -> DataFrame:
    keys = ["source_table", "source_column", "target_table", "target_column"]
    return lineage.filter(F.col("source_column").isNotNull() & F.col("target_column").isNotNull()).groupBy(*keys).agg(
        F.min("lineage_type").alias("lineage_type"))


def layout(rows: DataFrame, here: Sequence[str], there: Sequence[str], parts: int) -> tuple[DataFrame, DataFrame | None]:
    """``(adjacency, hubs)``: written edges laid out by the node they are entered from.

    Edges of a node with more than ``HUB_EDGES`` are spread over slots; ``hubs`` (here, slots) lists these nodes and is None
    if there are none.
    """
    laid = cut_lineage(rows.repartition(parts, *here))
    if parts == 1:
        return laid, None
    slots = F.ceil(F.col("n") / HUB_EDGES).cast("int")
    hubs = cut_lineage(laid.groupBy(*here).agg(F.count("*").alias("n")).filter(F.col("n") > HUB_EDGES).select(
        *here, slots.alias("slots")))
    if hubs.isEmpty():
        return laid, None
    spread = laid.join(F.broadcast(hubs), list(here), "left").withColumn(  # a node in HUB_EDGES at most is a hub
        "slot", F.pmod(F.xxhash64(*there), F.coalesce("slots", F.lit(1))).cast("int")).drop("slots")
    return cut_lineage(spread.repartition(parts, *here, "slot")), hubs


def _known(columns: Sequence[str]) -> Column:
    return reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])


def walk(edges: DataFrame, start: Sequence[str], source: Sequence[str], target: Sequence[str], node: Sequence[str],
         depth: int | None, direction: str) -> tuple[DataFrame, DataFrame]:
    """``(nodes with their level, edges touched)`` around one start node; DOWN, UP or BOTH.

    ``source``, ``target`` and ``node`` name the columns that make up an edge end and a node. Without a depth the walk
    goes on until no new node is found. A round joins the frontier, which holds distinct new nodes only, to the edges
    entered from it, and takes off nodes known before: both ways these can only be in the last two levels, one way in any.
    """
    spark, node = edges.sparkSession, list(node)
    here, there = ([f"{side}_{k}" for k in range(len(node))] for side in ("here", "there"))
    ways = [(source, target)] * (direction != "UP") + [(target, source)] * (direction != "DOWN")
    columns = edges.columns
    rows, size = cut_and_count(reduce(DataFrame.unionByName, [edges.filter(_known(a)).withColumns(
        {**{h: F.col(c) for h, c in zip(here, a)}, **{t: F.col(c) for t, c in zip(there, b)}}) for a, b in ways]))
    parts = parts_for(spark, size, PART_EDGES)
    with settled_plans(spark, parts):
        adjacency, hubs = layout(rows, here, there, parts)
        adjacency.persist()  # read in every step; what is written stays behind it

        frontier = spark.createDataFrame([tuple(start)], ", ".join(f"{n} string" for n in node))
        levels, level = [frontier], 0
        seen = Layers(lambda a, b: a.unionByName(b).repartition(parts, *node))
        seen.add(frontier, 1)
        while depth is None or level < depth:
            known = levels[-2:] if len(ways) > 1 else list(seen)
            frames = {f"known_{k}": f for k, f in enumerate(known)} | ({"hubs": hubs} if hubs else {})
            frontier, size = cut_and_count(spark.sql(step(node, len(known), parts if hubs else 0), adjacency=adjacency,
                                                     frontier=levels[-1], **frames))
            if not size:
                break
            level += 1
            levels.append(frontier)
            if len(ways) == 1:
                seen.add(frontier, size)
        adjacency.unpersist()
    nodes = reduce(DataFrame.unionByName, [f.withColumn("level", F.lit(k)) for k, f in enumerate(levels)])
    entered = nodes if depth is None else nodes.filter(F.col("level") < depth)
    touched = adjacency.join(entered.select(*[F.col(n).alias(h) for n, h in zip(node, here)]), here, "left_semi").select(*columns)
    return nodes, touched.distinct() if len(ways) > 1 else touched


def step(node: Sequence[str], known: int, hub_parts: int) -> str:
    """One round of a walk as a statement: distinct nodes one step from {frontier} that are in none of the known frames."""
    text, side, slot = "", "{frontier}", ""
    if hub_parts:
        same = " AND ".join(f"h.here_{k} = f.{n}" for k, n in enumerate(node))
        text = f"""WITH spread AS (SELECT /*+ BROADCAST(h) */ f.*, EXPLODE(SEQUENCE(0, COALESCE(h.slots, 1) - 1)) AS slot FROM {{frontier}} f
  LEFT JOIN {{hubs}} h ON {same}), laid AS (SELECT /*+ REPARTITION({hub_parts}, {', '.join(node)}, slot) */ * FROM spread) """
        side, slot = "laid", " AND a.slot = f.slot"
    met = " AND ".join(f"a.here_{k} = f.{n}" for k, n in enumerate(node)) + slot
    there = ", ".join(f"a.there_{k} AS {n}" for k, n in enumerate(node))
    some = " AND ".join(f"a.there_{k} IS NOT NULL" for k in range(len(node)))
    text += f"""SELECT n.* FROM (SELECT /*+ SHUFFLE_HASH(f) */ DISTINCT {there} FROM {{adjacency}} a LEFT SEMI JOIN {side} f ON {met} WHERE {some}) n"""
    for k in range(known):
        text += f" LEFT ANTI JOIN {{known_{k}}} k{k} ON " + " AND ".join(f"k{k}.{n} = n.{n}" for n in node)
    return text


def _tables(lineage: DataFrame, table: str, depth: int | None, direction: str) -> tuple[DataFrame, DataFrame]:
    return walk(table_edges(lineage), [table], ["source_table"], ["target_table"], ["table_name"], walk_depth(depth),
                direction)


def impact(lineage: DataFrame, table: str, depth: int | None = DEFAULT_DEPTH) -> tuple[DataFrame, DataFrame]:
    """Everything downstream of a table."""
    return _tables(lineage, table, depth, "DOWN")


def origin(lineage: DataFrame, table: str, depth: int | None = DEFAULT_DEPTH) -> tuple[DataFrame, DataFrame]:
    """Everything upstream of a table."""
    return _tables(lineage, table, depth, "UP")


def neighbourhood(lineage: DataFrame, table: str, depth: int | None = DEFAULT_DEPTH) -> tuple[DataFrame, DataFrame]:
    """Both directions from every node reached."""
    return _tables(lineage, table, depth, "BOTH")


def column_lineage(lineage: DataFrame, table: str, column: str, depth: int | None = None) -> DataFrame:
    """Column links around one column, both ways, to the end unless a depth is given."""
    return walk(column_links(lineage), [table, column], ["source_table", "source_column"],
                ["target_table", "target_column"], ["table_name", "column_name"], walk_depth(depth), "BOTH")[1]


def with_scores(nodes: DataFrame, scores: DataFrame) -> DataFrame:
    """Nodes with the whole part of their score and their health; unscored nodes carry nulls."""
    shown = scores.select("table_name", F.floor("score").cast("int").alias("quality_score"), "health_level")
    return nodes.join(shown, "table_name", "left")


def lineage_records(lineage: DataFrame, target_table: str | None = None, dag_id: int | None = None,
                    order: str = "id") -> DataFrame:
    """Records of one target table or one graph, newest first."""
    rows = lineage
    if target_table is not None:
        rows = rows.filter(F.col("target_table") == target_table)
    if dag_id is not None:
        rows = rows.filter(F.col("dag_id") == dag_id)
    return rows.orderBy(F.desc(order))


def peeled(nodes: DataFrame, edges: DataFrame, keys: Sequence[str], source: str, target: str) -> DataFrame:
    """Keys with their level, null for nodes in or behind a cycle; ``keys`` name the graph, then the node.

    A node's level is the longest way to it from a node without incoming edges. Every round takes the nodes that became
    free, counts the edges that fall with them, and writes a counter for each node these lead to, once; a node is free
    when its counters add up to its incoming edges. So over all rounds no more counters are written than there are edges,
    besides the merging of old ones.
    """
    graph, node = keys
    edges, size = cut_and_count(edges.select(graph, source, target))
    parts = parts_for(nodes.sparkSession, size, PART_EDGES)
    with settled_plans(nodes.sparkSession, parts):
        laid = cut_lineage(edges.repartition(parts, graph, source)).persist()
        incoming = cut_lineage(laid.groupBy(graph, F.col(target).alias(node)).agg(F.count("*").alias("incoming")))
        free = cut_lineage(nodes.select(*keys).repartition(parts, *keys).join(incoming, list(keys), "left_anti"))
        levels, level = [free], 0
        lowered = Layers(lambda a, b: a.unionByName(b).repartition(parts, *keys).groupBy(*keys).agg(F.sum("fell").alias("fell")))
        size = 1
        while size:
            tails = free.select(graph, F.col(node).alias(source)).hint("shuffle_hash")
            fallen = laid.join(tails, [graph, source], "left_semi").groupBy(graph, F.col(target).alias(node)).agg(
                F.count("*").alias("fell"))
            so_far = fallen.join(incoming, list(keys)).withColumn("total", F.col("fell"))
            for k, known in enumerate(lowered):
                before = known.select(*keys, F.col("fell").alias(f"fell_{k}")).hint("shuffle_hash")
                so_far = so_far.join(before, list(keys), "left").withColumn(
                    "total", F.col("total") + F.coalesce(f"fell_{k}", F.lit(0))).drop(f"fell_{k}")
            counters = cut_lineage(so_far.select(*keys, "fell", (F.col("total") == F.col("incoming")).alias("free")))
            found = counters.agg(F.count_if("free").alias("free"), F.count("*").alias("n")).first()
            size, free = found["free"], counters.filter("free").select(*keys)
            if size:
                level += 1
                levels.append(free)
            if found["n"] > size:
                lowered.add(counters.filter("NOT free").select(*keys, "fell"), found["n"] - size)
        laid.unpersist()
    done = reduce(DataFrame.unionByName, [f.withColumn("level", F.lit(k)) for k, f in enumerate(levels)])
    return nodes.select(*keys).join(done, list(keys), "left")


def graph_audit(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(per node, per graph)`` findings over many dependency graphs at once.

    Nodes: level from the roots (null inside or behind a cycle), root and isolated flags. Graphs: counts, edges with
    unknown ends, and whether a cycle exists. The levels of all graphs are peeled together, so the number of rounds is the
    longest path of any graph.
    """
    nodes = cut_lineage(nodes.select("graph_id", "node_id").distinct())
    raw = edges.select("graph_id", "source", "target").distinct()
    named = lambda c: nodes.select("graph_id", F.col("node_id").alias(c))
    valid = cut_lineage(raw.join(named("source"), ["graph_id", "source"], "left_semi").join(
        named("target"), ["graph_id", "target"], "left_semi").select("graph_id", "source", "target"))
    levels = peeled(nodes, valid, ["graph_id", "node_id"], "source", "target")
    ends = valid.select("graph_id", F.col("source").alias("node_id"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(
        valid.select("graph_id", "target", F.lit(0), F.lit(1)))
    degree = ends.groupBy("graph_id", "node_id").agg(F.sum("out").alias("out_degree"), F.sum("in").alias("in_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    sizes = nodes.groupBy("graph_id").agg(F.count("*").alias("nodes"))
    per_node = levels.join(degree, ["graph_id", "node_id"], "left").join(sizes, "graph_id").select(
        "graph_id", "node_id", "level", (zero("in_degree") == 0).alias("is_root"),
        ((zero("in_degree") + zero("out_degree") == 0) & (F.col("nodes") > 1)).alias("is_isolated"))
    counts = raw.groupBy("graph_id").agg(F.count("*").alias("edges"))
    good = valid.groupBy("graph_id").agg(F.count("*").alias("valid_edges"))
    per_graph = per_node.groupBy("graph_id").agg(
        F.count("*").alias("nodes"), count_when(F.col("is_root")).alias("roots"),
        count_when(F.col("is_isolated")).alias("isolated"), (F.max("level") + 1).alias("levels"),
        F.max(F.col("level").isNull()).alias("cyclic"))
    per_graph = per_graph.join(counts, "graph_id", "left").join(good, "graph_id", "left").select(
        "graph_id", "nodes", "roots", "isolated", "levels", "cyclic", zero("valid_edges").alias("valid_edges"),
        (zero("edges") - zero("valid_edges")).alias("dangling_edges"))
    return per_node, per_graph
