"""Path finding by level-wise joins. Edges are walked both ways unless told
otherwise; only the frontier's edges are touched in a level."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphlake.graph import Graph, walkable
from graphlake.sources.workspace import materialised



class BudgetExceeded(RuntimeError):
    """A search ran out of its budget; there is no partial result."""


@dataclass
class Budget:
    """Rows that a search may expand in all, and seconds it may take; it is checked
    after every level."""

    rows: int | None = None
    seconds: float | None = None
    _began: float = field(default_factory=time.monotonic)
    _spent: int = 0

    def spend(self, level: DataFrame) -> None:
        if self.rows is not None:
            self._spent += level.count()
            if self._spent > self.rows:
                raise BudgetExceeded(f"more than {self.rows} rows")
        if self.seconds is not None and time.monotonic() - self._began > self.seconds:
            raise BudgetExceeded(f"more than {self.seconds} seconds")


STEP = "struct<edge_id:bigint,edge_type:string,direction:string,src:bigint,dst:bigint,weight:double>"


def _alone(spark: SparkSession, id: int) -> DataFrame:
    """(id) of one row. Spark knows how small it is, as it does not of rows that come
    from Python, and broadcasts it; else a first level would shuffle all edges."""
    return spark.range(1).select((F.col("id") + F.lit(id)).alias("id"))


def _steps(graph: Graph, direction: str, edge_filter: Column | None, vertex_filter: Column | None, edge_cost: Column | None = None, vertex_cost: Column | None = None, within: DataFrame | None = None) -> DataFrame:
    """(near, far, edge_id, edge_type, direction, weight) of the walkable steps;
    the vertex filter and cost are those of the vertex a step arrives at.

    With ``within`` (id) they are those between these vertices, found once and
    stored. It is a condition and not a join, which Spark would not take below the
    window that numbers the edges of a table: only what is kept is shuffled for it."""
    e = graph.edges if edge_filter is None else graph.edges.where(edge_filter)
    e = e.withColumn("__w", F.lit(1.0) if edge_cost is None else F.coalesce(edge_cost.cast("double"), F.lit(1.0)))
    if within is not None:
        e = materialised(e.where(F.col("src").isin(within) & F.col("dst").isin(within)).select("id", "src", "dst", "edge_type", "__w"))
    steps = walkable(e, direction, "__w").withColumnRenamed("id", "edge_id")
    if vertex_filter is not None or vertex_cost is not None:
        v = graph.vertices if vertex_filter is None else graph.vertices.where(vertex_filter)
        v = v.select(F.col("id").alias("__v"), (F.lit(0.0) if vertex_cost is None else F.coalesce(vertex_cost.cast("double"), F.lit(0.0))).alias("__c"))
        steps = steps.join(v, F.col("far") == F.col("__v")).withColumn("__w", F.col("__w") + F.col("__c"))
    return steps.select("near", "far", "edge_id", "edge_type", "direction", F.greatest("__w", F.lit(0.0)).alias("weight"))


def reach(graph: Graph, source: int, max_depth: int, direction: str = "both", edge_filter: Column | None = None, vertex_filter: Column | None = None, until: int | None = None, budget: Budget | None = None) -> DataFrame:
    """(id, depth) of the vertices within ``max_depth`` hops, the source at 0; with
    ``until`` the search ends at the level that holds it."""
    spark = graph.vertices.sparkSession
    steps = _steps(graph, direction, edge_filter, vertex_filter).select("near", "far")
    seen = _alone(spark, source).withColumn("depth", F.lit(0))
    frontier = seen
    for depth in range(1, max_depth + 1):
        found = steps.join(frontier.select(F.col("id").alias("near")), "near").select(F.col("far").alias("id")).distinct()
        frontier = materialised(found.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        if budget:
            budget.spend(frontier)
        if not frontier.limit(1).count():
            break
        seen = seen.unionAll(frontier)
        if until is not None and frontier.where(F.col("id") == until).limit(1).count():
            break
    return seen


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], f"hops int, weight double, signature string, steps array<{STEP}>")


def _step() -> Column:
    return F.struct("edge_id", "edge_type", "direction", F.col("near").alias("src"), F.col("far").alias("dst"), "weight")


def _signature(steps: Column) -> Column:
    """Orders paths of equal length and weight: edge ids with their directions."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["edge_id"].cast("string"), F.lit(":"), s["direction"])), ",")


BACK = {"both": "both", "out": "in", "in": "out"}


def meeting(graph: Graph, source: int, target: int, max_depth: int = 7, direction: str = "both", edge_filter: Column | None = None, vertex_filter: Column | None = None, budget: Budget | None = None) -> tuple[list[DataFrame], list[DataFrame]] | None:
    """Search from both ends, a level at a time from the end whose frontier is
    smaller, until a vertex is on both: the levels (id) from the source and those
    from the target, whose last ones meet; None if they do not within the depth."""
    spark = graph.vertices.sparkSession
    levels, sizes = ([_alone(spark, source)], [_alone(spark, target)]), [1, 1]
    seen = [_alone(spark, source), _alone(spark, target)]
    # The ends are exempt from the filter; it is that of the vertex a step arrives at.
    passing = None if vertex_filter is None else (vertex_filter | F.col("id").isin(source, target))
    steps = [_steps(graph, d, edge_filter, passing).select("near", "far") for d in (direction, BACK[direction])]
    for _ in range(max_depth):
        side = 0 if sizes[0] <= sizes[1] else 1
        found = steps[side].join(levels[side][-1].select(F.col("id").alias("near")), "near").select(F.col("far").alias("id")).distinct()
        level = materialised(found.join(seen[side], "id", "left_anti"))
        if budget:
            budget.spend(level)
        sizes[side] = level.count()
        if not sizes[side]:
            return None
        levels[side].append(level)
        seen[side] = seen[side].unionAll(level)
        if level.join(levels[1 - side][-1], "id", "left_semi").limit(1).count():
            return levels
    return None


def fewest_hops(graph: Graph, source: int, target: int, max_depth: int = 7, max_results: int = 65_535, direction: str = "both", edge_filter: Column | None = None, vertex_filter: Column | None = None, budget: Budget | None = None) -> DataFrame:
    """All paths of the fewest hops, one per choice of parallel edges, by signature
    (hops, weight 0, signature, steps). None if an end is missing, they are the
    same, or the depth does not reach. The ends are exempt from the vertex filter.

    The search runs from both ends until they meet; the paths are then walked back
    through the levels, and only vertices on both sides' levels join the halves.
    """
    spark = graph.vertices.sparkSession
    ends = graph.vertices.where(F.col("id").isin(source, target)).select("id").distinct().count()
    if source == target or max_depth < 1 or max_results < 1 or ends < 2:
        return _empty(spark)
    met = meeting(graph, source, target, max_depth, direction, edge_filter, vertex_filter, budget)
    if met is None:
        return _empty(spark)
    ahead, behind = met
    levels = ahead[:-1] + [ahead[-1].join(behind[-1], "id", "left_semi")] + behind[-2::-1]
    passing = None if vertex_filter is None else (vertex_filter | F.col("id").isin(source, target))
    steps = _steps(graph, direction, edge_filter, passing, within=reduce(DataFrame.unionAll, levels).distinct())
    paths = _alone(spark, target).select(F.col("id").alias("at"), F.array().cast(f"array<{STEP}>").alias("steps"))
    for before in levels[-2::-1]:
        last = steps.join(before.select(F.col("id").alias("near")), "near", "left_semi").withColumn("weight", F.lit(0.0))
        paths = paths.join(last, F.col("at") == F.col("far")).select(F.col("near").alias("at"), F.concat(F.array(_step()), "steps").alias("steps"))
        paths = materialised(paths)
        if budget:
            budget.spend(paths)
    out = paths.select(F.size("steps").alias("hops"), F.lit(0.0).alias("weight"), _signature(F.col("steps")).alias("signature"), "steps")
    return out.orderBy("signature").limit(max_results)


def cheapest(graph: Graph, source: int, max_depth: int = 7, edge_cost: Column | None = None, vertex_cost: Column | None = None, max_weight: float = float("inf"), direction: str = "both", edge_filter: Column | None = None, vertex_filter: Column | None = None, budget: Budget | None = None) -> DataFrame:
    """(id, hops, weight): least weight from the source to every vertex with at
    most ``max_depth`` hops, and the fewest hops at that weight.

    A round relaxes only the states that improved in the round before; a state of
    more hops that is no cheaper is dropped."""
    spark = graph.vertices.sparkSession
    steps = _steps(graph, direction, edge_filter, vertex_filter, edge_cost, vertex_cost)
    best = _alone(spark, source).select("id", F.lit(0).alias("hops"), F.lit(0.0).alias("weight"))
    frontier = best
    for depth in range(1, max_depth + 1):
        found = steps.join(frontier.select(F.col("id").alias("near"), F.col("weight").alias("so_far")), "near")
        found = found.select(F.col("far").alias("id"), (F.col("so_far") + F.col("weight")).alias("weight")).where(F.col("weight") <= max_weight)
        found = found.groupBy("id").agg(F.min("weight").alias("weight"))
        known = best.select("id", F.col("weight").alias("old"))
        frontier = found.join(known, "id", "left").where("old is null or weight < old").select("id", F.lit(depth).alias("hops"), "weight")
        frontier = materialised(frontier)
        if budget:
            budget.spend(frontier)
        if not frontier.limit(1).count():
            break
        best = materialised(best.unionAll(frontier).groupBy("id").agg(F.min(F.struct("weight", "hops")).alias("b")).select("id", "b.hops", "b.weight"))
    return best


def _togo(graph: Graph, target: int, max_depth: int, edge_cost: Column | None, vertex_cost: Column | None, direction: str, edge_filter: Column | None, budget: Budget | None) -> DataFrame:
    """(far, togo, least): the fewest hops from a vertex to the target, and a weight
    that no path from there goes below."""
    hops = reach(graph, target, max_depth, BACK[direction], edge_filter, budget=budget).select(F.col("id").alias("far"), F.col("depth").alias("togo"))
    if vertex_cost is not None:  # the cost of a vertex is that of arriving there, so it has no reverse
        return materialised(hops.withColumn("least", F.lit(0.0)))
    if edge_cost is None:  # a hop weighs 1
        return materialised(hops.withColumn("least", F.col("togo").cast("double")))
    least = cheapest(graph, target, max_depth, edge_cost, direction=BACK[direction], edge_filter=edge_filter, budget=budget)
    return materialised(hops.join(least.select(F.col("id").alias("far"), F.col("weight").alias("least")), "far"))


def _on_the_way(graph: Graph, source: int, togo: DataFrame, edge_cost: Column | None = None, vertex_cost: Column | None = None, direction: str = "both", edge_filter: Column | None = None, vertex_filter: Column | None = None) -> DataFrame:
    """The steps between vertices that the target can be reached from."""
    within = togo.select(F.col("far").alias("id")).unionAll(_alone(graph.vertices.sparkSession, source))
    return _steps(graph, direction, edge_filter, vertex_filter, edge_cost, vertex_cost, within)


def simple_paths(graph: Graph, source: int, target: int, max_depth: int, max_weight: float = float("inf"), edge_cost: Column | None = None, vertex_cost: Column | None = None, direction: str = "both", edge_filter: Column | None = None, vertex_filter: Column | None = None, budget: Budget | None = None, togo: DataFrame | None = None, steps: DataFrame | None = None) -> DataFrame:
    """Every loop-free path of at most ``max_depth`` hops. Partial paths are cut off
    at once where the target is out of reach in the hops left, or where the least
    weight from there to the target passes ``max_weight``; ``togo`` and ``steps`` may
    give these distances and the steps to take, where they are known, as ``_togo``
    and ``_on_the_way`` find them."""
    spark = graph.vertices.sparkSession
    togo = _togo(graph, target, max_depth - 1, edge_cost, vertex_cost, direction, edge_filter, budget) if togo is None else togo
    steps = _on_the_way(graph, source, togo, edge_cost, vertex_cost, direction, edge_filter, vertex_filter) if steps is None else steps
    slack = 1e-9 * (1 + abs(max_weight)) if max_weight < float("inf") else 0.0  # sums from the two ends round differently
    paths = _alone(spark, source).select(F.col("id").alias("at"), F.array("id").alias("visited"), F.lit(0.0).alias("so_far"), F.array().cast(f"array<{STEP}>").alias("steps"))
    done = None
    for depth in range(1, max_depth + 1):
        on = paths.join(steps, F.col("at") == F.col("near")).where(~F.array_contains("visited", F.col("far")))
        on = on.join(togo, "far").where(F.col("togo") <= max_depth - depth).withColumn("total", F.col("so_far") + F.col("weight")).where(F.col("total") <= max_weight).where(F.col("total") + F.col("least") <= max_weight + slack)
        on = materialised(on.select(F.col("far").alias("at"), F.concat("visited", F.array("far")).alias("visited"), F.col("total").alias("so_far"), F.concat("steps", F.array(_step())).alias("steps")))
        if budget:
            budget.spend(on)
        arrived = on.where(F.col("at") == target)
        done = arrived if done is None else done.unionAll(arrived)
        paths = on.where(F.col("at") != target)
        if not paths.limit(1).count():
            break
    if done is None:
        return _empty(spark)
    return done.select(F.size("steps").alias("hops"), F.col("so_far").alias("weight"), _signature(F.col("steps")).alias("signature"), "steps")


def k_cheapest(graph: Graph, source: int, target: int, k: int = 1, max_depth: int = 7, **how) -> DataFrame:
    """The k loop-free paths of least weight, by (weight, hops, signature).

    The search is bounded: the k-th least weight of the paths found within few hops
    bounds the weight of all deeper ones, so each deeper pass only keeps partial
    paths that can still be among the k. All passes walk the same stored steps, and
    the first one is that of the fewest hops."""
    spark = graph.vertices.sparkSession
    ends = graph.vertices.where(F.col("id").isin(source, target)).select("id").distinct().count()
    if source == target or k < 1 or max_depth < 1 or ends < 2:
        return _empty(spark)
    bound = how.pop("max_weight", float("inf"))
    togo = _togo(graph, target, max_depth - 1, how.get("edge_cost"), how.get("vertex_cost"), how.get("direction", "both"), how.get("edge_filter"), how.get("budget"))
    steps = _on_the_way(graph, source, togo, **{key: value for key, value in how.items() if key != "budget"})
    nearest = togo.where(F.col("far") == source).select("togo").first()
    best = F.row_number().over(Window.orderBy("weight", "hops", "signature"))
    found = None
    for depth in range(nearest[0] if nearest else max_depth, max_depth + 1):
        found = materialised(simple_paths(graph, source, target, depth, bound, togo=togo, steps=steps, **how).orderBy("weight", "hops", "signature").limit(k))
        weights = [r[0] for r in found.select("weight").orderBy("weight").collect()]
        if len(weights) == k:
            bound = min(bound, weights[-1])
    return found.withColumn("rank", best).orderBy("rank")


def edge_sweep(graph: Graph) -> DataFrame:
    """Touch every out-edge and its target: (edges, checksum)."""
    touched = graph.edges.join(graph.vertices.select(F.col("id").alias("dst")), "dst")
    return touched.agg(F.count("*").alias("n_edges"), F.sum(F.col("dst") % 1_000_003).alias("checksum"))
