"""A graph store of Parquet tables: scans, look-ups, writes, deletes, metadata."""

from __future__ import annotations

import datetime as dt

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.graph import PropertyGraph
from quiver.schema import METADATA, METADATA_VERSION, GraphError, NotFound

ENGINE_VERSION = "1.0"


class GraphStore:
    """Tables ``nodes``, ``edges`` and ``meta`` below one folder, in any store that Spark reads.

    A write makes a new generation beside the old ones; the newest that is complete is current, so that readers, and a
    failed write, keep the old tables whole. Writers claim a generation's number by a file that only one can create.
    """

    def __init__(self, spark: SparkSession, path: str, read_only: bool = False):
        self.spark, self.path, self.read_only = spark, path.rstrip("/"), read_only
        jvm = spark._jvm
        self._hadoop = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- generations

    def _generations(self) -> list[int]:
        place = self._hadoop(self.path)
        if not self._fs.exists(place):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(place)]
        done = [int(n[4:]) for n in names if n.startswith("gen-") and n[4:].isdigit()]
        return sorted(g for g in done if self._fs.exists(self._hadoop(f"{self.path}/gen-{g}/_COMPLETE")))

    def current(self) -> str:
        found = self._generations()
        if not found:
            raise NotFound(f"{self.path} holds no graph")
        return f"{self.path}/gen-{found[-1]}"

    def _claim(self) -> str:
        """A new generation's folder, after all that others have begun."""
        place = self._hadoop(self.path)
        names = [s.getPath().getName() for s in self._fs.listStatus(place)] if self._fs.exists(place) else []
        number = max([int(n[4:]) for n in names if n.startswith("gen-") and n[4:].isdigit()], default=0) + 1
        while True:
            try:
                self._fs.create(self._hadoop(f"{self.path}/gen-{number}/_WRITER"), False).close()
                return f"{self.path}/gen-{number}"
            except Py4JJavaError as e:
                if not self._fs.exists(self._hadoop(f"{self.path}/gen-{number}/_WRITER")):
                    raise GraphError(f"{self.path} can't be written: {e.java_exception}") from e
                number += 1

    def marked(self, mark: str) -> bool:
        """Whether the current generation was saved with this mark."""
        return bool(self._generations()) and self._fs.exists(self._hadoop(f"{self.current()}/_MARK-{mark}"))

    def save(self, graph: PropertyGraph, metadata: list[dict] | None = None, mark: str | None = None) -> None:
        """Write all tables; edges that lack endpoints are kept. Without metadata, the old one's is carried over.

        ``mark`` is a name that ``marked`` finds while this generation is the current one.
        """
        if self.read_only:
            raise GraphError("the store is open for reading only")
        found = self._generations()
        old = self.metadata() if metadata is None and found else None
        place = self._claim()
        graph.write(place)
        meta = old if old is not None else metadata_table(self.spark, metadata or [{}])
        meta.write.mode("overwrite").parquet(f"{place}/meta")
        if mark is not None:
            self._fs.create(self._hadoop(f"{place}/_MARK-{mark}")).close()
        self._fs.create(self._hadoop(f"{place}/_COMPLETE")).close()

    def compact(self, keep: int = 1) -> int:
        """Delete all but the newest generations; how many went."""
        gone = self._generations()[:-keep] if keep else []
        for g in gone:
            self._fs.delete(self._hadoop(f"{self.path}/gen-{g}"), True)
        return len(gone)

    def size(self) -> int:
        """Bytes of the current generation's files."""
        return self._fs.getContentSummary(self._hadoop(self.current())).getLength()

    def delete(self) -> None:
        """Remove the whole store, if it looks like one."""
        if self.read_only:
            raise GraphError("the store is open for reading only")
        place = self._hadoop(self.path)
        if not self._fs.exists(place):
            return
        names = [s.getPath().getName() for s in self._fs.listStatus(place)]
        if any(not n.startswith("gen-") for n in names):
            raise GraphError(f"{self.path} has files that no graph store makes; it is left alone")
        self._fs.delete(place, True)

    # -- reading

    def load(self) -> PropertyGraph:
        return PropertyGraph.read(self.spark, self.current())

    def metadata(self) -> DataFrame:
        return self.spark.read.schema(METADATA).parquet(f"{self.current()}/meta")

    def scan(self, table: str = "nodes") -> DataFrame:
        return getattr(self.load(), table)

    def scan_prefix(self, prefix: str) -> DataFrame:
        """Nodes whose id starts with a prefix; the test is pushed to the files' statistics."""
        return self.load().nodes.filter(F.col("id").startswith(prefix))

    def get(self, node_id: str) -> dict:
        return self.load().node(node_id)

    # -- writing

    def put(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> None:
        graph = self.load()
        if nodes is not None:
            graph = graph.add_nodes(nodes)
        if edges is not None:
            graph = graph.add_edges(edges, strict=False)
        self.save(graph)

    def remove(self, *ids: str) -> None:
        """Delete nodes by id; one that is missing is no error."""
        graph = self.load()
        gone = self.spark.createDataFrame([(x,) for x in ids], "id string")
        self.save(PropertyGraph(graph.nodes.join(gone, "id", "left_anti").select(*graph.nodes.columns), graph.edges))


def metadata_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Metadata rows with their defaults: this schema's version, this engine's, now."""
    default = {
        "schema_version": METADATA_VERSION, "engine_version": ENGINE_VERSION,
        "analyzed_at": dt.datetime.now(dt.timezone.utc), "include_tests": False, "git_available": False,
    }
    return spark.createDataFrame([tuple((default | r).get(f.name) for f in METADATA) for r in rows], METADATA)


def load_all(stores: list[GraphStore]) -> PropertyGraph:
    """Several stores as one graph: nodes of all before edges of any; earlier stores write first."""
    return PropertyGraph.merged([s.load() for s in stores])
