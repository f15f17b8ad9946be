"""Edge operations as a stream: every micro-batch changes the graph and republishes the result.

Deletions make the input a stream of retractions, which Structured Streaming's
own aggregations do not take; the batches go through ``foreachBatch``. Results
are written as version = batch + 1 (0 is the initial run) and writing one again
replaces it, so a batch that is replayed after a failure does no harm.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.graph import Change, Graph
from ..operators.ingest import Options, batched, parse_ops, process_batch
from ..plans import bsp, monotonic
from ..plans.adaptive import Adaptive
from ..sources.edgelist import in_file_order, write_result
from ..sources.storage import materialize


@dataclass
class Engine:
    """A program kept current. ``program`` is a VertexProgram or a PathProgram."""

    program: object
    graph: Graph
    options: Options = Options()
    output: str | None = None
    values: tuple[str, ...] = ()
    state: object = None
    version: int = -1
    counts: list[dict[str, int]] = field(default_factory=list)
    #: Decides batch by batch between refinement and a run from scratch (vertex programs).
    adaptive: Adaptive | None = None
    #: Folder for what a restart needs: the graph of the last version, and the number of the last batch in it.
    home: str | None = None
    last: int = -1

    def _kit(self):
        return bsp if isinstance(self.program, bsp.VertexProgram) else monotonic

    def start(self) -> Engine:
        """From the graph given, or from where a stopped engine with the same ``home`` left off."""
        spark = self.graph.edges.sparkSession
        if saved := self.saved(spark):
            self.version, self.last, n, path = saved
            self.graph = Graph(spark.range(n), spark.read.schema(self.graph.edges.schema).parquet(path))
            self.version -= 1  # published again: the stop may have come before
        else:
            self.graph = Graph(self.graph.vertices, materialize(self.graph.edges, "edges"))
        self.state = self._kit().run(self.program, self.graph)
        self.publish()
        return self

    def saved(self, spark: SparkSession) -> tuple[int, int, int, str] | None:
        if not self.home:
            return None
        try:
            rows = spark.read.schema("version int, last long, n long, path string").json(f"{self.home}/versions")
            found = rows.where("path IS NOT NULL").orderBy(F.desc("version"), F.desc("last")).first()
        except AnalysisException:  # nothing saved yet
            return None
        return tuple(found) if found else None

    def save(self) -> None:
        """The graph first, the line that names it last: a stop between the two leaves the version before valid."""
        spark = self.graph.edges.sparkSession
        path = f"{self.home}/edges-{self.version}-{uuid.uuid4().hex}"
        self.graph.edges.write.parquet(path)
        n = self.graph.vertices.count()
        spark.createDataFrame([(self.version, self.last, n, path)], "version int, last long, n long, path string").coalesce(1).write.mode("append").json(f"{self.home}/versions")

    def publish(self) -> None:
        self.version += 1
        if self.output:
            write_result(self.state.result(), self.output, self.version, list(self.values))

    def batch(self, ops: DataFrame) -> Engine:
        """One batch of parsed operations. A batch without effect republishes the result."""
        change, rejected = process_batch(self.graph, ops, self.options)
        after = Graph(change.after.vertices, materialize(change.after.edges, "edges"))
        change = Change(self.graph, after, materialize(change.added, "added"), materialize(change.deleted, "deleted"))
        self.counts.append({r["reason"]: r["count"] for r in rejected.groupBy("reason").count().collect()})
        old = self.state
        adapt = self.adaptive and self._kit() is bsp
        self.state = self.adaptive.advance(old, change) if adapt else self._kit().refine(old, change)
        if self._kit() is bsp:
            old.release()
        self.graph = after
        self.publish()
        return self

    def replayed(self, lines: DataFrame, size: int, most: int | None = None, weighted: bool = False) -> Engine:
        """Operations (seq, value) in batches of ``size``, of usable ones if Options.fixed_size; at most ``most`` batches."""
        ops = materialize(batched(self.parsed(lines, weighted), size, self.options.fixed_size), "ops")
        top = ops.agg(F.max("batch")).first()[0]
        n = 0 if top is None else top + 1
        for k in range(n if most is None else min(n, most)):
            self.batch(ops.where(F.col("batch") == k).drop("batch"))
        return self

    @staticmethod
    def parsed(lines: DataFrame, weighted: bool = False) -> DataFrame:
        ops = parse_ops(lines, weighted)
        return ops.withColumn("w", F.col("payload").try_cast("double")).drop("payload") if weighted else ops

    def each(self, weighted: bool = False) -> Callable[[DataFrame, int], None]:
        """The body for ``foreachBatch``."""

        def body(lines: DataFrame, number: int) -> None:
            if number <= self.last:
                return
            ordered = in_file_order(lines) if "file_path" in lines.columns else lines.select(F.monotonically_increasing_id().alias("seq"), "value")
            self.batch(materialize(self.parsed(ordered, weighted), "ops"))
            self.last = number
            if self.home:
                self.save()

        return body


def stream(spark: SparkSession, engine: Engine, path: str, checkpoint: str, files: int = 1, weighted: bool = False) -> StreamingQuery:
    """Starts a query over a folder of operation files: ``files`` of them make a batch; ends when all are read."""
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").text(path)
    lines = lines.select("value", "_metadata.file_path", "_metadata.file_block_start")
    return lines.writeStream.foreachBatch(engine.each(weighted)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
