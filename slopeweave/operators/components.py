"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from slopeweave.operators.blocks import local_components
from slopeweave.operators.joins import attach
from slopeweave.session import cut, cut_counting

# Edges that a task holds at once; a scope with more goes through the rounds.
EDGES_AT_ONCE = 1 << 20


def components(edges: DataFrame, scope: list[str]) -> DataFrame:
    """``(scope, node, root)`` for every node of ``edges (scope, a, b)``; the root is the least
    node of the component. Edges are in the scope's own numbering; components do not cross scopes.

    Edges are put in order of their scope once, spread over the tasks by ranges. A scope that lies within one task and has ``EDGES_AT_ONCE`` edges at most is finished
    there; only the edges of the others, the one or two at the ends of each task and the large ones, go through the rounds.
    """
    kind = edges.schema["a"].dataType.simpleString()
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    written = cut(edges.select(*scope, "a", F.col("b").cast(kind).alias("b")).filter("a <> b"), "edges")
    fields = ", ".join(f"`{c}` {edges.schema[c].dataType.simpleString()}" for c in scope)
    found, seen = cut_counting(
        written.repartitionByRange(parts, *scope, "a").sortWithinPartitions(*scope, "a")
        .mapInArrow(_within_tasks(scope), f"{fields}, node {kind}, root {kind}, whole boolean"),
        "local", left=F.count_if(~F.col("whole")))
    done = found.filter("whole").drop("whole")
    if not seen["left"]:
        return done
    rest = found.filter("NOT whole").select(*scope, F.col("node").alias("a"), F.col("root").alias("b"))
    return done.unionByName(_in_rounds(rest, scope))


def _within_tasks(scope: list[str], most: int | None = None):
    """Labels of the scopes that lie within one task, ``whole``, and the edges ``(node, root)`` of the others as they are.

    A task's rows come in order of their scope. Its first scope may have begun in the task before and its last may go on in the next, so these two are left.
    """
    most = most or EDGES_AT_ONCE

    def labelled(rows: pa.Table, group: np.ndarray) -> pa.Table:
        a, b = rows["a"].to_numpy(), rows["b"].to_numpy()
        groups, nodes = np.concatenate([group, group]), np.concatenate([a, b])
        order = np.lexsort((nodes, groups))
        groups, nodes = groups[order], nodes[order]
        new = np.append(True, (groups[1:] != groups[:-1]) | (nodes[1:] != nodes[:-1]))
        index = np.empty(len(order), np.int64)
        index[order] = np.cumsum(new) - 1
        root = local_components(index[:len(a)], index[len(a):], int(new.sum()))
        row = order[new] % len(a)
        return out(rows.select(scope).take(pa.array(row)), nodes[new], nodes[new][root], True)

    def out(keys: pa.Table, node, root, whole: bool) -> pa.Table:
        return pa.table([*keys.columns, pa.array(node), pa.array(root), pa.array(np.full(len(keys), whole))], [*scope, "node", "root", "whole"])

    def left(rows: pa.Table) -> pa.Table:
        return out(rows.select(scope), rows["a"].to_numpy(), rows["b"].to_numpy(), False)

    def split(held: pa.Table, end: bool, begun: bool) -> tuple[list[pa.Table], pa.Table, bool]:
        """What ``held`` gives, what of it is kept on, and whether the first scope of that is already left."""
        new = np.zeros(len(held), bool)
        for c in scope:
            code = held[c].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        starts = np.flatnonzero(new)
        first = 0 if not begun else (int(starts[0]) if len(starts) else len(held))
        last = int(starts[-1]) if len(starts) else 0
        parts = [left(held.slice(0, first))] if first else []
        if last > first:
            parts.append(labelled(held.slice(first, last - first), np.cumsum(new)[first:last]))
        tail = held.slice(max(first, last))
        if len(tail) and (end or len(tail) >= most):
            return [*parts, left(tail)], tail.slice(0, 0), True
        return parts, tail, not len(tail)

    def run(batches):
        held, size, begun = [], 0, True
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= most:
                parts, tail, begun = split(pa.Table.from_batches(held), False, begun)
                held, size = tail.to_batches(), len(tail)
                yield from (b for p in parts for b in p.to_batches())
        if size:
            yield from (b for p in split(pa.Table.from_batches(held), True, begun)[0] for b in p.to_batches())

    return run


def _in_rounds(edges: DataFrame, scope: list[str]) -> DataFrame:
    """``components`` of scopes of any size.

    Every round hooks each node to its least neighbour and contracts the edges, so their
    number falls in every round and so does that of the nodes. The hooks of each round are kept; at the end each round's are led on to where the later rounds'
    lead, from the last round, which has the fewest, to the first, and only then all nodes look up their root, once.
    """
    ends = [*scope, "a", "b"]
    edges = cut(edges.select(*scope, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                .filter("a <> b").distinct(), "edges")
    nodes = edges.select(*scope, F.explode(F.array("a", "b")).alias("root")).distinct()
    rounds = []
    while True:
        both = edges.unionByName(edges.select(*scope, F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = cut(both.groupBy(*scope, F.col("a").alias("root"))
                    .agg(F.min("b").alias("parent")).filter("parent < root"), "hooks")
        hooks = _to_tops(hooks, scope)
        rounds.append(hooks)
        moved = _relabel(_relabel(edges, hooks, scope, "a"), hooks, scope, "b")
        edges, seen = cut_counting(
            moved.filter("a <> b")
            .select(*scope, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct().select(*ends), "edges", left=F.count(F.lit(1)))
        if not seen["left"]:
            break
    tops = rounds.pop()
    while rounds:
        tops = cut(_relabel(rounds.pop(), tops.withColumnRenamed("parent", "_next"), scope, "parent", "_next").unionByName(tops), "tops")
    return _relabel(nodes.withColumn("node", F.col("root")), tops, scope, "root").select(*scope, "node", "root")


def _relabel(df: DataFrame, hooks: DataFrame, scope: list[str], name: str, to: str = "parent") -> DataFrame:
    """Replace ``name`` by what it is hooked to, ``to``, where it is."""
    parents = hooks.withColumnRenamed("root", name)
    return (attach(df, parents, [*scope, name], "left")
            .withColumn(name, F.coalesce(to, name)).select(*df.columns))


def _to_tops(hooks: DataFrame, scope: list[str]) -> DataFrame:
    """Follow parents upward, twice as far each round, until no parent is itself hooked."""
    while True:
        above = hooks.select(*scope, F.col("root").alias("parent"), F.col("parent").alias("_top"))
        hooks, seen = cut_counting(
            attach(hooks, above, [*scope, "parent"], "left")
            .select(*scope, "root", F.coalesce("_top", "parent").alias("parent"), F.col("_top").alias("_top")),
            "hooks", moved=F.count("_top"))
        hooks = hooks.drop("_top")
        if not seen["moved"]:
            return hooks
