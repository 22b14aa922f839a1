"""Connected components of links, in blocks of bounded size and in rounds of label propagation."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import mapped, saved, scratch, with_group

#: Edges that a task thins out at a time; its table of nodes is bounded by twice as many.
BLOCK = 1 << 17


def thinned(edges: DataFrame, blocks: int) -> DataFrame:
    """a, b: edges that join up just what ``edges`` (a, b: longs) do, a spanning star forest of each of ``blocks`` blocks.

    a is the smallest node that its block links b with. Blocks are dealt evenly, whatever
    groups there are; a task holds the nodes of one block.
    """
    def run(batches):
        above: dict[int, int] = {}

        def top(x):
            while (up := above.setdefault(x, x)) != x:
                above[x] = x = above.setdefault(up, up)
            return x

        for b in batches:
            for x, y in zip(b["a"].to_pylist(), b["b"].to_pylist()):
                x, y = top(x), top(y)
                if x != y:
                    above[max(x, y)] = min(x, y)
        found = [(top(x), x) for x in list(above)]
        found = [f for f in found if f[0] != f[1]]
        for at in range(0, len(found), 10_000):
            some = found[at: at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in some], pa.int64()), pa.array([y for _, y in some], pa.int64())], ["a", "b"])

    return mapped(edges.select("a", "b").repartition(blocks), run, "a long, b long")


def components(edges: DataFrame, block: int | None = None, most_rounds: int = 100) -> DataFrame:
    """node and label, the smallest node that it is linked with, for every node of ``edges`` (a, b: longs) with a link.

    Blocks of edges are cut to spanning forests as long as that halves them; what fits in
    one block is solved by it. Edges that stay more than a block are solved in rounds, each
    written to the shared folder: a node, and the node that it is labelled with, take the
    smallest label next to it, and then that label's own label; so rounds grow with the
    logarithm of a chain's length. A node that most others are linked with is joined by
    broadcast. Over ``most_rounds`` rounds are an error. Links of a node with itself do
    not count. No edges: no rows.
    """
    with scratch(edges.sparkSession) as keep:
        return keep(saved(_components(edges, block or BLOCK, most_rounds)))


def _components(edges: DataFrame, block: int, most_rounds: int) -> DataFrame:
    n = edges.count()
    while n:
        blocks = -(-n // block)
        edges = saved(thinned(edges, blocks))
        if blocks == 1:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(
                edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
        before, n = n, edges.count()
        if 2 * n > before:
            break
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"), F.count(F.lit(1)).alias("links")))
    n, total = labels.count(), both.count()
    for _ in range(most_rounds):
        if not n:
            break
        next_to = labels.select(F.col("node").alias("b"), "label", "links")
        around = with_group(both, next_to, ["b"], "links", total).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        known = saved(labels.join(around, "node").withColumn("near", F.least("near", "label")))
        hooked = saved(
            known.select("node", F.col("near").alias("label"))
            .union(known.groupBy(F.col("label").alias("node")).agg(F.min("near").alias("label")))
            .groupBy("node").agg(F.min("label").alias("label"))
        )
        uses = hooked.groupBy("label").agg(F.count(F.lit(1)).alias("uses"))
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("next")).join(uses, "label")
        new = with_group(hooked, jump, ["label"], "uses", n).select("node", F.least("label", "next").alias("label"))
        new = saved(new.join(labels.select("node", "links", F.col("label").alias("was")), "node"))
        changed = new.where("label <> was").limit(1).count()
        labels = new.drop("was")
        if not changed:
            break
    else:
        raise RuntimeError(f"labels still change after {most_rounds} rounds")
    return labels.select("node", "label")
