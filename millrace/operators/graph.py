"""Property graphs over node and edge tables.

A pattern is a list of hops; each hop is one equi-join of the paths so far with
the edges and one with the nodes. Quantified hops loop over path lengths with a
checkpoint a round; shortest and cheapest paths keep only the best of each
(start, end) pair as they go.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Hop:
    """An edge pattern and the node it leads to.

    ``edge_filter`` sees columns e.*, ``node_filter`` columns n.*; ``low`` and
    ``high`` quantify the hop (None: no upper bound).
    """

    label: str | None = None
    direction: str = "right"
    edge_filter: Column | None = None
    node_label: str | None = None
    node_filter: Column | None = None
    low: int = 1
    high: int | None = 1


@dataclass
class Graph:
    """nodes (id, label, ...) and edges (id, label, src, dst, ...)."""

    nodes: DataFrame
    edges: DataFrame

    def _steps(self, hop: Hop) -> DataFrame:
        e = self.edges.alias("e")
        e = e.where(F.col("e.label") == hop.label) if hop.label else e
        e = e.where(hop.edge_filter) if hop.edge_filter is not None else e
        one = e.select(F.col("e.src").alias("__from"), F.col("e.dst").alias("__to"), F.col("e.id").alias("__edge"), *self._cost())
        back = one.select(F.col("__to").alias("__from"), F.col("__from").alias("__to"), "__edge", *[c for c in one.columns if c == "__cost"])
        return {"right": one, "left": back, "any": one.unionByName(back)}[hop.direction]

    def _cost(self) -> list[Column]:
        return [F.col("e.cost").cast("double").alias("__cost")] if "cost" in self.edges.columns else [F.lit(1.0).alias("__cost")]

    def match(self, *hops: Hop, start_label: str | None = None, start_filter: Column | None = None, mode: str = "WALK", search: str = "ALL", most: int = 50) -> DataFrame:
        """Paths as start, end, nodes, edges, length and cost.

        ``mode``: WALK, TRAIL (no edge twice), ACYCLIC (no node twice) or SIMPLE
        (no node twice but the first as the last). ``search``: ALL, ANY, ANY
        SHORTEST, ALL SHORTEST or CHEAPEST.
        """
        n = self.nodes.alias("n")
        n = n.where(F.col("n.label") == start_label) if start_label else n
        n = n.where(start_filter) if start_filter is not None else n
        ident = F.col("n.id")
        paths = n.select(
            ident.alias("start"), ident.alias("end"), F.array(ident).alias("nodes"),
            F.array().cast(f"array<{self.edges.schema['id'].dataType.simpleString()}>").alias("edges"), F.lit(0.0).alias("cost"),
        )
        for hop in hops:
            paths = self._extend(paths, hop, mode, search, most)
        return self._select(paths, search).withColumn("length", F.size("edges"))

    def _extend(self, paths: DataFrame, hop: Hop, mode: str, search: str, most: int) -> DataFrame:
        steps = self._steps(hop)
        out = paths if hop.low == 0 else None
        k, top = 0, hop.high if hop.high is not None else most
        best = None
        while True:
            if k >= top:
                if hop.high is None:
                    raise RuntimeError(f"paths haven't ended after {most} hops; name a mode, a search or a bound")
                break
            k += 1
            met = paths.join(steps, F.col("end") == F.col("__from"))
            if mode == "TRAIL":
                met = met.where(~F.array_contains("edges", F.col("__edge")))
            elif mode == "ACYCLIC":
                met = met.where(~F.array_contains("nodes", F.col("__to")))
            elif mode == "SIMPLE":
                inner = F.slice("nodes", 2, F.greatest(F.size("nodes") - 1, F.lit(0)))
                done = (F.size("edges") > 0) & (F.element_at("nodes", 1) == F.element_at("nodes", -1))
                met = met.where(~F.array_contains(inner, F.col("__to")) & ~done)
            paths = met.select(
                "start", F.col("__to").alias("end"), F.concat("nodes", F.array("__to")).alias("nodes"),
                F.concat("edges", F.array("__edge")).alias("edges"), (F.col("cost") + F.col("__cost")).alias("cost"),
            )
            if hop.high is None or hop.high > 1:
                if search in ("ANY", "ANY SHORTEST", "CHEAPEST"):
                    paths = self._select(paths, search)
                    if best is not None:  # go on only from where this round is better
                        old = best.select(F.col("start").alias("__s"), F.col("end").alias("__e"), F.col("cost").alias("__c"))
                        better = F.col("__c") > F.col("cost") if search == "CHEAPEST" else F.lit(False)
                        paths = paths.join(old, (F.col("start") == F.col("__s")) & (F.col("end") == F.col("__e")), "left")
                        paths = paths.where(F.col("__s").isNull() | better).drop("__s", "__e", "__c")
                if search == "ALL SHORTEST":  # go on only to ends that no shorter path has reached
                    if best is not None:
                        old = best.select(F.col("start").alias("__s"), F.col("end").alias("__e"))
                        paths = paths.join(old, (F.col("start") == F.col("__s")) & (F.col("end") == F.col("__e")), "left_anti")
                    paths = paths.checkpoint()
                    ends = paths.select("start", "end").distinct()
                    best = (ends if best is None else best.unionByName(ends)).checkpoint()
                paths = paths.checkpoint()
                if paths.isEmpty():
                    break
                if search in ("ANY", "ANY SHORTEST", "CHEAPEST"):
                    best = paths if best is None else self._select(best.unionByName(paths), search).checkpoint()
            if k >= hop.low:
                out = paths if out is None else out.unionByName(paths)
        if out is None:
            out = paths.where(F.lit(False))
        end = self.nodes.alias("n")
        end = end.where(F.col("n.label") == hop.node_label) if hop.node_label else end
        end = end.where(hop.node_filter) if hop.node_filter is not None else end
        return out.join(end.select(F.col("n.id").alias("__n")), F.col("end") == F.col("__n"), "left_semi")

    @staticmethod
    def _select(paths: DataFrame, search: str) -> DataFrame:
        if search == "ALL":
            return paths
        size = F.size("edges")
        if search == "ALL SHORTEST":
            least = paths.groupBy(F.col("start").alias("__s"), F.col("end").alias("__e")).agg(F.min(size).alias("__l"))
            cond = (F.col("start") == F.col("__s")) & (F.col("end") == F.col("__e")) & (size == F.col("__l"))
            return paths.join(least, cond, "left_semi")
        rank = F.struct("cost", size, "nodes", "edges") if search == "CHEAPEST" else F.struct(size, "nodes", "edges")
        best = paths.groupBy("start", "end").agg(F.min_by(F.struct("nodes", "edges", "cost"), rank).alias("p"))
        return best.select("start", "end", "p.*")


def is_trail(edges: Column) -> Column:
    """No edge twice."""
    return F.size(F.array_distinct(edges)) == F.size(edges)


def is_acyclic(nodes: Column) -> Column:
    """No node twice."""
    return F.size(F.array_distinct(nodes)) == F.size(nodes)


def is_simple(nodes: Column) -> Column:
    """No node twice, but that the last may be the first."""
    return is_acyclic(nodes) | (is_acyclic(F.slice(nodes, 2, F.size(nodes) - 1)) & (F.element_at(nodes, 1) == F.element_at(nodes, -1)))
