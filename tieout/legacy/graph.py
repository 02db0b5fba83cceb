"""The knowledge store: a versioned graph in parquet, partitioned by version.

Tables are small and immutable per version; amendments are allowed in drafts only and journalled;
certifying a version supersedes the certified one before.
"""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut

ENGINE = "tieout-1"
HOPS = 4
#: Nodes that link everything (records, programs, data stores) are reported but not passed through. Fixed values.
HUBS = ("rec:", "pgm:", "ds:")


def fingerprint(contents: dict[tuple[str, str], bytes], mode: str = "offline") -> str:
    """Of (kind, name) to file contents, salted with engine and mode; the same inputs give the same 16 digits."""
    lines = sorted(f"{k}:{n}:{hashlib.sha256(b).hexdigest()}" for (k, n), b in contents.items())
    return hashlib.sha256("\n".join([*lines, ENGINE, mode]).encode()).hexdigest()[:16]


@dataclass
class Store:
    spark: SparkSession
    path: str

    def _read(self, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)  # nothing written yet

    def _append(self, table: str, rows: list[tuple], schema: str) -> None:
        if rows:
            self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{table}")

    NODES, EDGES = "version int, id string, kind string, label string, props string", "version int, src string, dst string, kind string"
    EVENTS = "version int, state string, at double, fingerprint string, note string"

    def nodes(self) -> DataFrame:
        return self._read("nodes", self.NODES)

    def edges(self) -> DataFrame:
        return self._read("edges", self.EDGES)

    def events(self) -> DataFrame:
        return self._read("events", self.EVENTS)

    def versions(self) -> DataFrame:
        """(version, state): the latest event of each version; a certified one before another is superseded."""
        last = self.events().groupBy("version").agg(F.max_by("state", "at").alias("state"), F.max("fingerprint").alias("fingerprint"))
        newest = last.where("state = 'certified'").agg(F.max("version").alias("v")).first()["v"]
        return last.withColumn("state", F.when((F.col("state") == "certified") & (F.col("version") < F.lit(newest)), "superseded").otherwise(F.col("state")))

    def create(self, nodes: list[tuple[str, str, str, dict]], edges: list[tuple[str, str, str]], print_: str = "") -> int:
        v = (self.events().agg(F.max("version")).first()[0] or 0) + 1
        self._append("nodes", [(v, i, k, lab, json.dumps(p, sort_keys=True)) for i, k, lab, p in nodes], self.NODES)
        self._append("edges", [(v, *e) for e in dict.fromkeys(edges)], self.EDGES)
        self._append("events", [(v, "draft", time.time(), print_, "created")], self.EVENTS)
        return v

    def state(self, version: int) -> str | None:
        r = self.versions().where(F.col("version") == version).first()
        return r.state if r else None

    def certify(self, version: int, note: str = "") -> None:
        if self.state(version) not in ("draft", "certified"):
            raise ValueError(f"version {version} can't be certified")
        if self.state(version) == "draft":
            self._append("events", [(version, "certified", time.time(), "", note)], self.EVENTS)

    def amend(self, version: int, nodes: list[tuple[str, str, str, dict]], note: str) -> None:
        if self.state(version) != "draft":
            raise ValueError("only drafts are amended")
        self._append("nodes", [(version, i, k, lab, json.dumps(p, sort_keys=True)) for i, k, lab, p in nodes], self.NODES)
        self._append("events", [(version, "draft", time.time(), "", note)], self.EVENTS)

    def latest(self) -> int | None:
        return self.versions().where("state = 'certified'").agg(F.max("version")).first()[0]

    def replay(self, print_: str) -> int | None:
        """A version made from the same inputs."""
        r = self.events().where((F.col("fingerprint") == print_) & (F.col("fingerprint") != "")).agg(F.max("version")).first()[0]
        return r

    def export(self, version: int) -> str:
        n = [r.asDict() for r in self.nodes().where(F.col("version") == version).orderBy("id").collect()]
        e = [r.asDict() for r in self.edges().where(F.col("version") == version).orderBy("src", "dst", "kind").collect()]
        return json.dumps({"version": version, "nodes": n, "edges": e}, sort_keys=True)


def search(nodes: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Nodes whose id or label holds the text, shortest labels first. A top-k report."""
    t = text.lower()
    return nodes.where(F.contains(F.lower("label"), F.lit(t)) | F.contains(F.lower("id"), F.lit(t))).orderBy(F.length("label"), "id").limit(limit)


def lineage(edges: DataFrame, start: str, hops: int = HOPS) -> DataFrame:
    """(src, dst, kind) of edges within ``hops`` of a node, either way; hubs are reached but not passed through.

    One join a hop over the frontier; each hop's edges are cut in the shared folder, so plans don't grow.
    """
    e = cut(edges.select("src", "dst", "kind").distinct())
    frontier = e.sparkSession.createDataFrame([(start,)], "node string")
    seen, found = frontier, None
    hub = lambda c: F.lit(False) | c.startswith(HUBS[0]) | c.startswith(HUBS[1]) | c.startswith(HUBS[2])
    for _ in range(hops):
        hit = cut(e.join(frontier.withColumnRenamed("node", "src"), "src", "left_semi").unionByName(e.join(frontier.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", "kind")))
        found = hit if found is None else found.unionByName(hit)
        ends = hit.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        frontier = ends.join(seen, "node", "left_anti").where(~hub(F.col("node")))
        seen = seen.unionByName(ends)
    return found.distinct()


def reach(uses: DataFrame, start: str, depth: int) -> DataFrame:
    """(variable) reached over (variable, depends_on) edges, the start included."""
    out = frontier = uses.sparkSession.createDataFrame([(start,)], "variable string")
    for _ in range(depth):
        nxt = uses.join(frontier, "variable", "left_semi").select(F.col("depends_on").alias("variable")).distinct()
        frontier = cut(nxt.join(out, "variable", "left_anti"))
        if not frontier.limit(1).count():
            break
        out = out.unionByName(frontier)
    return out
