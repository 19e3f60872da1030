"""File events to graph updates: routing, debouncing in session windows, and slice replacement per micro-batch."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quiver.functions.text import basename, dirname
from quiver.graph import PropertyGraph
from quiver.schema import GraphError
from quiver.sources.filesystem import KEPT_DOT_FILES, SKIPPED_FOLDERS
from quiver.sources.storage import GraphStore

EVENTS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("op", T.StringType()),  # create, write, remove, rename
        T.StructField("is_dir", T.BooleanType()),
        T.StructField("ts", T.TimestampType()),
    ]
)
GAP = "500 milliseconds"
PACKAGE, TREE, REFRESH, REMOVE = "package", "tree", "refresh", "remove"


def skipped(path: Column) -> Column:
    """Whether a part of the path is one that walks leave out."""
    hidden = F.exists(F.split(path, "/"), lambda x: x.isin(*SKIPPED_FOLDERS))
    name = basename(path)
    dot = F.exists(F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1), lambda x: x.startswith(".") & (x != "."))
    return hidden | dot | (name.startswith(".") & ~name.isin(*KEPT_DOT_FILES))


def routed(events: DataFrame) -> DataFrame:
    """Events with action and target: a Go file updates its package's folder, a new folder its tree, another new file the
    structure; a removed one its path. Writes to other files, and skipped names, are left out.
    """
    go, op = F.col("path").endswith(".go"), F.col("op")
    gone = op.isin("remove", "rename")
    is_dir = F.coalesce("is_dir", F.lit(False))
    action = (
        F.when(is_dir & (op == "create"), TREE).when(go & ~is_dir, PACKAGE).when(gone, REMOVE).when(op == "create", REFRESH)
    )
    target = F.when(F.col("action") == PACKAGE, dirname(F.col("path"))).when(F.col("action") == REFRESH, "").otherwise(F.col("path"))
    rows = events.filter(~skipped(F.col("path"))).withColumn("action", action).filter(F.col("action").isNotNull())
    return rows.withColumn("target", target)


def debounced(events: DataFrame, gap: str = GAP, by: tuple[str, ...] = ("action", "target"), time: str = "ts") -> DataFrame:
    """One row for each burst: events of a key less than ``gap`` apart, with their number and the burst's start and end.

    Works on tables and, with a watermark on the time, on streams.
    """
    window = F.session_window(time, gap)
    rows = events.groupBy(window.alias("burst"), *by).agg(F.count("*").alias("n_events"))
    return rows.select(*by, F.col("burst.start").alias("burst_start"), F.col("burst.end").alias("burst_end"), "n_events")


#: Makes a package's slice again from its folder. None: the folder has no Go files left. An exception: it can't be parsed.
Slices = Callable[[str], "tuple[str, PropertyGraph] | None"]


class GraphUpdater:
    """Applies debounced updates to a store; a micro-batch makes one new generation, or none if all of it fails.

    ``parse`` gives a folder's package path and slice. ``package_of`` names a folder's package when it has no files left.
    ``folders`` lists the folders with packages at or below a path, ``root`` is the path of the whole repository.
    ``structure`` walks the file system.
    """

    def __init__(
        self, store: GraphStore, parse: Slices, package_of: Callable[[str], str], structure: Callable[[], PropertyGraph] | None = None,
        metadata: Callable[[], list[dict]] | None = None, folders: Callable[[str], list[str]] = lambda path: [path], root: str = "",
    ):
        self.store, self.parse, self.package_of, self.structure, self.metadata = store, parse, package_of, structure, metadata
        self.folders, self.root = folders, root
        self.failures: list[tuple[str, str]] = []

    def apply(self, updates: DataFrame, batch_id: int = 0, stream: str | None = None) -> None:
        """One micro-batch of (action, target), as one plan: old packages go in one pass, all new slices come together.

        A changed file's folder is parsed again, and every package folder of a new tree. A removed path takes all
        packages that have files below it, and then the whole repository is parsed again; if it had none, only the
        structure is new. A slice that can't be parsed keeps its old rows. A batch that the stream gives again after it
        was saved changes nothing.
        """
        # a batch's targets are few: each is work for the parser outside Spark
        rows = [(r.action, r.target) for r in updates.select("action", "target").distinct().orderBy("action", "target").collect()]
        mark = None if stream is None else f"{sha256(stream.encode()).hexdigest()[:16]}-{batch_id}"
        if not rows or (mark is not None and self.store.marked(mark)):
            return
        graph = self.store.load()
        wanted = dict.fromkeys(t for a, t in rows if a == PACKAGE)
        wanted |= dict.fromkeys(f for a, t in rows if a == TREE for f in self.folders(t))
        lost = [t for a, t in rows if a == REMOVE]
        below = graph.packages_below(lost) if lost else None
        if below is not None and below.isEmpty():
            below = None
        elif below is not None and self.root:
            wanted |= dict.fromkeys(self.folders(self.root))
        names, slices = [], []
        for folder in wanted:
            try:
                found = self.parse(folder)  # before anything is removed
            except (GraphError, OSError, ValueError) as e:
                self.failures.append((folder, str(e)))
                continue
            names.append(self.package_of(folder) if found is None else found[0])
            slices += [] if found is None else [found[1]]
        if names or below is not None:
            old = graph.nodes.sparkSession.createDataFrame([(x,) for x in names], "pkg_path string")
            graph = graph.remove_packages(old if below is None else old.union(below))
            graph = graph.add(PropertyGraph.merged(slices)) if slices else graph
        elif self.structure is None:
            return
        if self.structure is not None:
            graph = graph.replace_structure(self.structure())
        self.store.save(graph, self.metadata() if self.metadata else None, mark)


def maintain(events: DataFrame, updater: GraphUpdater, checkpoint: str, gap: str = GAP, delay: str = "10 seconds", **trigger) -> StreamingQuery:  # noqa: ANN003
    """Start a stream that keeps the updater's store current. ``delay`` bounds the state of open bursts."""
    bursts = debounced(routed(events.withWatermark("ts", delay)), gap)
    writer = bursts.writeStream.outputMode("append").foreachBatch(lambda rows, batch: updater.apply(rows, batch, checkpoint)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
