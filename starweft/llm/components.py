"""One group identifier for everything linked directly or through others.

Method: deterministic Boruvka hooking. Every component selects its smallest edge to another one (edges are ordered by their
two labels, so no two are equal and the selected edges form trees but for pairs that select each other, of which the smaller
label becomes the root); trees collapse by pointer doubling; edges are relabelled, loops dropped and duplicates merged, until
no edge is left. Each round at least halves the components that still have edges. The rounds' maps are staged tables and are
composed at the end, so neither links nor labels ever go to the driver.

Defined results: links with a null side are ignored, self links too (a node linked only to itself is in no group); repeated
and swapped links count once; without links the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import Stage, lookup


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): a label per node, equal for all nodes of a component; it is one of the component's nodes."""
    stage = Stage(links.sparkSession, "components")
    x, y = F.col(f"`{a}`"), F.col(f"`{b}`")

    def canonical(df: DataFrame, p: Column, q: Column) -> DataFrame:
        return df.filter(p.isNotNull() & q.isNotNull() & (p != q)).select(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")).distinct()

    edges, n_edges = stage.write_counted(canonical(links, x, y))
    maps: list[tuple[DataFrame, int]] = []
    while n_edges:
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("c"), "a", "b"), F.struct(F.col("b").alias("c"), "a", "b"))).alias("e"))
        chosen = ends.groupBy("e.c").agg(F.min(F.struct("e.a", "e.b")).alias("e"))
        hooks, n = stage.write_counted(chosen.select("c", F.when(F.col("e.a") == F.col("c"), F.col("e.b")).otherwise(F.col("e.a")).alias("p")))
        back = hooks.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        mutual = (F.col("pp") == F.col("c")) & (F.col("c") < F.col("p"))
        parents = stage.write(lookup(hooks, n, "p", back, n).select("c", F.when(mutual, F.col("c")).otherwise(F.col("p")).alias("p"), F.lit(True).alias("moved")))
        stage.drop(hooks)
        while True:
            up = parents.select(F.col("c").alias("p"), F.col("p").alias("pp"))
            doubled = stage.write(lookup(parents.select("c", "p"), n, "p", up, n).select("c", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
            stage.drop(parents)
            parents = doubled
            if parents.filter("moved").isEmpty():
                break
        labels = parents.select("c", F.col("p").alias("root"))
        maps.append((labels, n))
        by_a = lookup(edges, n_edges, "a", labels.select(F.col("c").alias("a"), F.col("root").alias("ra")), n)
        by_b = lookup(by_a.select("ra", "b"), n_edges, "b", labels.select(F.col("c").alias("b"), F.col("root").alias("rb")), n)
        left, n_left = stage.write_counted(canonical(by_b, F.col("ra"), F.col("rb")))
        stage.drop(edges)
        edges, n_edges = left, n_left
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out, n = maps[0]
    out = out.select(F.col("c").alias("node"), "root")
    for labels, n_labels in maps[1:]:
        later = labels.select(F.col("c").alias("root"), F.col("root").alias("later"))
        out = lookup(out, n, "root", later, n_labels, "left").select("node", F.coalesce("later", "root").alias("root"))
    return stage.write(out)


def groups(links: DataFrame, a: str = "a", b: str = "b", counts: Column | None = None) -> DataFrame:
    """(group_id, node): groups of two nodes or more, named by their smallest node. Nodes for which `counts` (a condition on
    `node`) fails only link others; they are in no result."""
    stage = Stage(links.sparkSession, "groups")
    found, n = stage.write_counted(components(links, a, b))
    kept = found if counts is None else found.filter(counts)
    names, n_names = stage.write_counted(kept.groupBy("root").agg(F.min("node").alias("group_id"), F.count("*").alias("n")).filter("n > 1").select("root", "group_id"))
    return lookup(kept, n, "root", names, n_names).select("group_id", "node")


def detection_groups(clusters: DataFrame, detections: DataFrame, pairs: DataFrame, catalog: DataFrame) -> DataFrame:
    """(group_id, detid) of all detids linked by the members of a cluster or by a matched pair.

    A cluster is a node of its own, linked with each of its members, so that a cluster of any size gives as many links as it
    has members. Detids get the mark 'd', clusters 'k'; the mark goes again at the end.
    """
    stage = Stage(clusters.sparkSession, "links")
    members = clusters.select("cluster_id", F.explode("local_intids").alias("intid")).filter("intid is not null and cluster_id is not null").distinct()
    named = detections.select("intid", "detid").filter("intid is not null and detid is not null")
    in_cluster = members.join(named, "intid").select(F.concat(F.lit("d"), "detid").alias("a"), F.concat(F.lit("k"), F.col("cluster_id").cast("string")).alias("b"))
    match = stage.write(pairs.filter("verdict = 'match'").select(F.trim("detid_a").alias("a"), F.trim("detid_b").alias("b")).filter("a is not null and b is not null and a <> b").distinct())
    sides = match.select(F.explode(F.array("a", "b")).alias("detid")).distinct()
    known, n = stage.write_counted(sides.join(catalog.select("detid").filter("detid is not null"), "detid", "left_semi"))
    rows = match.count()
    both = lookup(match, rows, "a", known.select(F.col("detid").alias("a")), n)
    both = lookup(both, rows, "b", known.select(F.col("detid").alias("b")), n)
    links = in_cluster.unionByName(both.select(F.concat(F.lit("d"), "a").alias("a"), F.concat(F.lit("d"), "b").alias("b")))
    out = groups(links, counts=F.col("node").startswith("d"))
    return out.select(F.substring("group_id", 2, 1 << 30).alias("group_id"), F.substring("node", 2, 1 << 30).alias("detid"))
