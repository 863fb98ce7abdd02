"""Layers of a citation graph fetched in batches, with a ledger from which any run resumes.

What has been fetched, and what came of it, are two stores with logs (``sources.commits``): edges, and a ledger of one row for each
node and try. A batch is committed edges first, ledger second, and edges are keyed
by content, so a crash between the two costs a fetch and changes no row. What comes next follows from the ledger alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.numbering import numbered
from lodestone.operators.staging import staged
from lodestone.sources.commits import Store

LEDGER = "node long, layer int, status string, n long"


@dataclass
class Plan:
    """todo: (node, layer, batch), the nodes of the lowest layer that isn't complete; batches, and calls that they will cost at
    most; waiting: layers whose frontier isn't known yet."""

    todo: DataFrame
    layer: int | None
    nodes: int
    batches: int
    calls: int
    waiting: int


class Collector:
    """[S8] ``fetch`` gives (src, dst) for a table of nodes (node); nodes for which it gives a null dst alone are missing at the
    source. ``failed`` (tests, outages) marks nodes of a batch that no answer came for."""

    def __init__(self, edges: Store, ledger: Store, fetch: Callable[[DataFrame], DataFrame], size: int = 100, tries: int = 3, failed: Callable[[Column], Column] | None = None):
        self.edges, self.ledger, self.fetch, self.size, self.tries, self.failed = edges, ledger, fetch, size, tries, failed

    def states(self, seeds: DataFrame, layers: int) -> DataFrame:
        """(node, layer, status, tries, n): of each known node its least layer and state. ``pending`` has no try yet, ``failed``
        none that was answered, ``lost`` as many as are allowed, ``complete`` an answer, ``missing`` one that says that the source
        lacks it."""
        spark = seeds.sparkSession
        log = self.ledger.read()
        log = log if log is not None else spark.createDataFrame([], LEDGER)
        done = log.groupBy("node").agg(F.count("*").alias("tries"), F.max(F.when(F.col("status") != "failed", F.struct("status", "n"))).alias("said"))
        seen = seeds.select(F.col("node").cast("long").alias("node")).distinct().withColumn("layer", F.lit(1))
        edges = self.edges.read()
        front = seen
        for layer in range(2, layers + 1):
            if edges is None:
                break
            step = front.join(edges.select(F.col("src").alias("node"), "dst"), "node").select(F.col("dst").alias("node")).where("node is not null").distinct()
            front = staged(step.join(seen.select("node"), "node", "left_anti").withColumn("layer", F.lit(layer)))
            seen = seen.unionByName(front)
        status = F.when(F.col("said").isNotNull(), F.col("said")["status"]).when(F.col("tries") >= self.tries, "lost").when(F.col("tries").isNotNull(), "failed").otherwise("pending")
        return seen.join(done, "node", "left").select("node", "layer", status.alias("status"), F.coalesce("tries", F.lit(0)).cast("long").alias("tries"), F.col("said")["n"].alias("n"))

    def plan(self, seeds: DataFrame, layers: int) -> Plan:
        """A layer's frontier isn't known before the layers below are fetched, so the lowest open one comes first."""
        now = staged(self.states(seeds, layers))
        open_ = now.where("status in ('pending', 'failed')")
        found = open_.groupBy("layer").count().orderBy("layer").first()
        if found is None:
            return Plan(open_.select("node", "layer", F.lit(0).cast("long").alias("batch")), None, 0, 0, 0, 0)
        rows = numbered(open_.where(F.col("layer") == found["layer"]).select("node", "layer"), [(F.col("node"), True)], "at")
        batches = -(-found["count"] // self.size)
        return Plan(rows.select("node", "layer", F.floor(F.col("at") / self.size).cast("long").alias("batch")), found["layer"], found["count"], batches, batches, layers - found["layer"])

    def run(self, seeds: DataFrame, layers: int, most: int | None = None, together: int = 1000) -> int:
        """Fetches until all layers are complete, or for so many batches; how many it fetched. Batches go to the source ``together``
        at a time, as one commit."""
        fetched = 0
        while most is None or fetched < most:
            plan = self.plan(seeds, layers)
            if not plan.batches:
                break
            todo = staged(plan.todo)
            for at in range(0, plan.batches, together):
                step = min(together, plan.batches - at, (most - fetched) if most is not None else together)
                if step <= 0:
                    break
                nodes = todo.where((F.col("batch") >= at) & (F.col("batch") < at + step))
                lost = self.failed(F.col("node")) if self.failed else F.lit(False)
                got = staged(self.fetch(nodes.where(~lost).select("node")).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct())
                answers = got.groupBy(F.col("src").alias("node")).agg(F.count("dst").alias("n"), F.lit(True).alias("there"))
                status = F.when(lost, "failed").when(F.col("there") & (F.col("n") > 0), "complete").otherwise("missing")
                self.edges.append(got.where("dst is not null"))
                self.ledger.append(nodes.join(answers, "node", "left").select("node", F.col("layer").cast("int").alias("layer"), status.alias("status"), F.when(status != "failed", F.coalesce("n", F.lit(0))).alias("n"), F.lit(self.ledger.manifest().number + 1).cast("long").alias("commit")))
                fetched += step
        return fetched
