"""A store: descriptions in pods, and the composites that are kept for them.

Descriptions and composites are keyed tables. A save changes the descriptions, finds every composite it touches and makes those
anew at once, or hands them on to a queue. Nothing is visible before its manifest is written, so a save that fails leaves the
old state.
"""

from __future__ import annotations

import time
import uuid
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import changes, composites, graphs, impact
from tessera.plans import compiler
from tessera.plans.config import KINDS, Config
from tessera.session import written
from tessera.sources.keyed import ConflictError, KeyedTable
from tessera.sources.pods import Pod, PropsPod, from_triples

LOG = "id string, status string, description string, pod string, start_time timestamp, end_time timestamp, error string, r string, c string, document string"
DESCRIPTIONS = "r string, c string, props array<struct<p:string,pos:int,k:string,v:string>>, _version bigint, _cts timestamp, _uts timestamp"


class SaveError(RuntimeError):
    """A save that didn't happen; the store is as it was."""


class Hook:
    """What a program wants to be told of saves: before, after, and when one fails. What a hook raises is counted and ignored."""

    def pre(self, save: dict) -> None: ...

    def success(self, save: dict) -> None: ...

    def failure(self, save: dict, error: Exception) -> None: ...


class Statistics:
    """Counters and times by name; a program may put another sink with these two functions in its place."""

    def __init__(self) -> None:
        self.counts: dict[str, int] = {}
        self.times: dict[str, list[float]] = {}

    def count(self, name: str, by: int = 1) -> None:
        self.counts[name] = self.counts.get(name, 0) + by

    def time(self, name: str, seconds: float) -> None:
        self.times.setdefault(name, []).append(seconds)


class Composite(ABC):
    """One kind of composites: how they are made, and which of them a change touches."""

    kind: str

    @abstractmethod
    def make(self, store: Store, spec: dict, keys: DataFrame | None) -> DataFrame:
        """r, c and whatever the kind has, for all roots or for those of keys (root_r, root_c)."""

    def impacted(self, store: Store, spec: dict, change: DataFrame, pod: str) -> DataFrame:
        """root_r, root_c of the composites of spec that a change (c, s, p) of a pod touches or calls for."""
        stored = store.table(self.kind, spec["_id"])
        keys = change.select(F.col("s").alias("root_r"), F.col("c").alias("root_c")).where(F.lit(False))
        if stored.newest() is not None:
            keys = impact.impacted(stored.read(), change, spec if self.kind != "view" else None)
        if spec["from"] == pod:
            keys = keys.unionByName(impact.triggered(store.pod(pod), change, spec, store.ns))
        return keys.distinct()


class Views(Composite):
    kind = "view"

    def make(self, store: Store, spec: dict, keys: DataFrame | None) -> DataFrame:
        rows = compiler.view(spec, store.pods, store.ns, keys)
        parts = None if "ttl" in spec else compiler.impact_index(spec, store.pods, store.ns, keys)
        return compiler.nested_view(rows, parts, spec["_id"], spec.get("ttl"))


class Tables(Composite):
    kind = "table"

    def make(self, store: Store, spec: dict, keys: DataFrame | None) -> DataFrame:
        return compiler.table(spec, store.pods, store.ns, keys)


class SearchProvider(Composite):
    """Search documents as rows. A program may give a store another provider with the same functions."""

    kind = "search"

    def make(self, store: Store, spec: dict, keys: DataFrame | None) -> DataFrame:
        return compiler.search_documents(spec, store.pods, store.ns, keys)

    def index(self, store: Store, documents: DataFrame, spec: str) -> None:
        """Puts documents in place of those with their keys."""
        if "type" not in documents.columns:
            raise composites.SearchError("a search document needs its type")
        store.table("search", spec).replace(documents, documents.select("r", "c"))

    def delete(self, store: Store, keys: DataFrame, names: Iterable[str] | None = None) -> None:
        """Takes the documents of keys (r, c) out of some search tables or all."""
        for name in names or store.config.specifications["search"]:
            store.delete("search", name, keys)

    def search(self, store: Store, text: str, spec: str, indices: list[str], fields: list[str], limit: int = 10, offset: int = 0) -> DataFrame:
        return composites.search(store.table("search", spec).read(), text, spec, indices, fields, limit, offset)


class _Pods(dict):
    """The pods of a store by name, each read when it is asked for."""

    def __init__(self, store: Store) -> None:
        super().__init__()
        self.store = store

    def __missing__(self, name: str) -> Pod:
        return self.store.pod(name)

    def __contains__(self, name: object) -> bool:
        return name in self.store.config.pods

    def __iter__(self):
        return iter(self.store.config.pods)


class Store:
    """A configured store below a folder that all executors share.

    Pods are stored there, or given as frames that are only read. `hooks`, `statistics`, `search` and the makers of composites can
    be replaced by a program.
    """

    def __init__(self, spark: SparkSession, config: Config, name: str, folder: str, given: dict[str, Pod] | None = None, hooks: Iterable[Hook] = (), statistics: Statistics | None = None, search: SearchProvider | None = None, buckets: int = 16) -> None:
        self.spark, self.config, self.ns = spark, config.store(name), config.ns
        self.context, self.folder, self.buckets = config.default_context, folder.rstrip("/"), buckets
        self.given, self.hooks, self.statistics = given or {}, list(hooks), statistics or Statistics()
        self.pods = _Pods(self)
        self.composites: dict[str, Composite] = {"view": Views(), "table": Tables(), "search": search or SearchProvider()}

    # What is stored.

    def _keyed(self, *names: str) -> KeyedTable:
        return KeyedTable(self.spark, "/".join((self.folder, *names)), self.buckets)

    def descriptions(self, pod: str) -> KeyedTable:
        self.config.pod(pod)
        return self._keyed("pods", pod)

    def pod(self, name: str) -> Pod:
        """A pod: given, or as stored; one that nothing was written to is empty."""
        self.config.pod(name)
        if name in self.given:
            return self.given[name]
        table = self.descriptions(name)
        return PropsPod(table.read() if table.newest() is not None else self.spark.createDataFrame([], DESCRIPTIONS))

    def table(self, kind: str, name: str) -> KeyedTable:
        self.config.specification(kind, name)
        return self._keyed(kind, name)

    def read(self, kind: str, names: Iterable[str] | None = None) -> DataFrame:
        """The composites of several specifications (None: all) in one frame, with the id of each in `spec`."""
        frames = [self.table(kind, n).read().withColumn("spec", F.lit(n)) for n in names or self.config.specifications[kind]]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    # Making composites.

    def generate(self, kind: str, name: str, keys: DataFrame | None = None) -> None:
        """All composites of a specification anew, or those of keys (r, c): what there is no description for any more goes."""
        began = time.perf_counter()
        spec = self.config.specification(kind, name)
        if keys is None:
            self.table(kind, name).create(self.composites[kind].make(self, spec, None))
        else:
            self._remake(kind, spec, keys.select(F.col("r").alias("root_r"), F.col("c").alias("root_c")))
        self.statistics.time(f"generate.{kind}.{name}", time.perf_counter() - began)

    def _remake(self, kind: str, spec: dict, keys: DataFrame, version: int | None = None) -> None:
        named = keys.select(F.col("root_r").alias("r"), F.col("root_c").alias("c"))
        self.table(kind, spec["_id"]).replace(self.composites[kind].make(self, spec, keys), named, version)

    def generate_for_type(self, wanted: str, kinds: Iterable[str] = KINDS) -> list[tuple[str, str]]:
        """Every specification of a type, written either way, generated whole; which they are."""
        done = [(kind, spec["_id"]) for kind in kinds for spec in self.config.of_type(kind, wanted, self.ns)]
        for kind, name in done:
            self.generate(kind, name)
        return done

    def regenerate(self, kind: str, keys: DataFrame, pod: str) -> None:
        """The composites of a kind of the subjects keys (r, c) of a pod, by all specifications that start there."""
        for spec in self.config.specifications[kind].values():
            if spec["from"] == pod:
                self.generate(kind, spec["_id"], keys)

    def delete(self, kind: str, name: str, keys: DataFrame) -> None:
        table = self.table(kind, name)
        if table.newest() is not None:
            table.replace(table.read().limit(0), keys)

    def views(self, name: str, keys: DataFrame, now: datetime | None = None) -> DataFrame:
        """The views of keys (r, c): those stored, and those that are missing or expired made first, where a description exists."""
        table = self.table("view", name)
        wanted = keys.select("r", "c").distinct()
        held = table.read().join(wanted, ["r", "c"], "left_semi") if table.newest() is not None else None
        missing = composites.missing_views(wanted, held, now) if held is not None else wanted
        pod = self.pod(self.config.specification("view", name)["from"])
        lacking = missing.join(pod.frame.select("r", "c"), ["r", "c"], "left_semi")
        if not lacking.isEmpty():
            self.statistics.count(f"view.{name}.made")
            self.generate("view", name, lacking)
        return table.read().join(wanted, ["r", "c"], "left_semi") if table.newest() is not None else self.composites["view"].make(self, self.config.specification("view", name), wanted.toDF("root_r", "root_c"))

    def view(self, name: str, r: str, c: str | None = None) -> DataFrame:
        """The view of one subject in a graph, the store's own where none is named."""
        return self.views(name, self.spark.createDataFrame([(r, c or self.context)], "r string, c string"))

    # Changes.

    def impacted(self, change: DataFrame, pod: str, kinds: Iterable[str] = KINDS) -> DataFrame:
        """kind, spec, root_r, root_c of everything that a change (c, s, p) of a pod touches, over all specifications."""
        found = [self.composites[k].impacted(self, s, change, pod).select(F.lit(k).alias("kind"), F.lit(s["_id"]).alias("spec"), "root_r", "root_c") for k in kinds for s in self.config.reading(k, pod)]
        empty = self.spark.createDataFrame([], "kind string, spec string, root_r string, root_c string")
        return reduce(DataFrame.unionByName, found, empty)

    def impacted_subjects(self, change: DataFrame, pod: str, kinds: Iterable[str] = KINDS) -> DataFrame:
        """root_r, root_c, specs: each subject of impacted() once, with the specifications to apply to it."""
        return self.impacted(change, pod, kinds).groupBy("root_r", "root_c").agg(F.array_sort(F.collect_set("spec")).alias("specs"))

    def apply(self, change: DataFrame, pod: str, kinds: Iterable[str] = KINDS, version: int | None = None) -> None:
        """Makes every composite that a change touches anew. With a `version` (of a batch) it can be done again to the same end."""
        for kind in kinds:
            for spec in self.config.reading(kind, pod):
                keys = written(self.composites[kind].impacted(self, spec, change, pod), "impacted")
                self._remake(kind, spec, keys, version)
                self.statistics.count(f"applied.{kind}.{spec['_id']}")

    def discover(self, change: DataFrame, pod: str) -> None:
        """Hands a change on to the queue, from which maintain() takes it."""
        change.select("c", "s", "p", F.lit(pod).alias("pod")).write.mode("append").parquet(f"{self.folder}/queue")

    def log(self) -> DataFrame:
        """The transaction log as it was written: each state of each transaction, completed ones by subject."""
        return self.spark.read.schema(LOG).parquet(f"{self.folder}/log")

    def transactions(self) -> DataFrame:
        """id, status, pod, description, error: the last state of each transaction."""
        order = F.struct(F.col("end_time").isNotNull(), F.col("status") != "cancelling")
        return self.log().groupBy("id").agg(F.max_by(F.struct("status", "pod", "description", "error"), order).alias("x")).select("id", "x.*")

    def _note(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.folder}/log")

    def _tell(self, moment: str, *arguments: object) -> None:
        for hook in self.hooks:
            try:
                getattr(hook, moment)(*arguments)
            except Exception:  # noqa: BLE001
                self.statistics.count(f"hook.{moment}.failed")

    def save(self, pod: str, before: DataFrame, after: DataFrame, context: str | None = None, description: str = "", now: datetime | None = None, queued: Iterable[str] = ()) -> str:
        """Saves the change from the triples `before` to `after` (s, p, k, o) of one graph; the id of the transaction.

        Cardinality is checked, the change applied to the newest state and logged, and the composites it touches are made anew; those
        of the kinds in `queued` are handed on instead. A removal of what isn't there, a violation or a lost race against another
        writer raises SaveError, and then the store, its composites included, is as it was.
        """
        self.config.pod(pod)
        if pod in self.given:
            raise SaveError(f"the pod {pod} is only read here")
        number, started = uuid.uuid4().hex, now or datetime.now(timezone.utc).replace(tzinfo=None)
        save = {"id": number, "pod": pod, "context": context or self.context, "description": description}
        self._tell("pre", save)
        head = lambda status, error=None: [(number, status, description, pod, started, None if status == "in_progress" else started, error)]
        state = lambda status, error=None: self.spark.createDataFrame(head(status, error), ", ".join(LOG.split(", ")[:7]))
        nobody = [F.lit(None).cast("string").alias(x) for x in ("r", "c", "document")]
        table = self.descriptions(pod)
        held = table.newest()
        try:
            changes.check_cardinality(after.withColumn("c", F.lit(save["context"])), self.config.single(pod))
            change = written(graphs.changes(before, after).withColumn("c", F.lit(save["context"])), "change")
            if change.isEmpty():
                self._tell("success", save)
                return number
            self._note(state("in_progress").select("*", *nobody))
            made, keys = self._changed(pod, change, started)
            table.replace(made, keys, expected=held)
            stored = table.read().join(keys, ["r", "c"], "left_semi").select("r", "c", F.to_json("props").alias("document"))
            documents = keys.join(stored, ["r", "c"], "left")
        except Exception as e:
            if self._log_exists(number):
                self._note(state("cancelling", str(e)[:2000]).select("*", *nobody))
                self._note(state("failed", str(e)[:2000]).select("*", *nobody))
            self.statistics.count("save.failed")
            self._tell("failure", save, e)
            if isinstance(e, (changes.CardinalityError, changes.ChangeError, ConflictError)):
                raise SaveError(str(e)) from e
            raise
        done = [F.lit(v).cast(x.split()[1]).alias(x.split()[0]) for v, x in zip(head("completed")[0], LOG.split(", "), strict=False)]
        self._note(documents.select(*done, "r", "c", "document"))
        touched = change.select("c", "s", "p").distinct()
        later = set(queued)
        self.apply(touched, pod, [k for k in KINDS if k not in later])
        if later:
            self.discover(touched, pod)
        self.statistics.count("save.done")
        self._tell("success", save)
        return number

    def _log_exists(self, number: str) -> bool:
        try:
            return not self.spark.read.schema(LOG).parquet(f"{self.folder}/log").where(F.col("id") == number).isEmpty()
        except Exception:  # noqa: BLE001
            return False

    def _changed(self, pod: str, change: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
        """(the changed descriptions, the keys r and c of all subjects of the change)."""
        keys = change.select(F.col("s").alias("r"), "c").distinct()
        table = self.descriptions(pod)
        old = table.read().join(keys, ["r", "c"], "left_semi") if table.newest() is not None else self.spark.createDataFrame([], DESCRIPTIONS)
        triples = changes.apply_changes(PropsPod(old).triples().select("c", "s", "p", "pos", "k", "o"), change)
        versions = changes.next_versions(old.select("c", F.col("r").alias("s"), "_version", "_cts", "_uts"), change, now)
        rows = from_triples(triples).frame.join(versions.withColumnRenamed("s", "r"), ["r", "c"])
        return rows.select("r", "c", "props", F.col("_version").cast("bigint").alias("_version"), "_cts", "_uts"), keys

    def load(self, pod: str, lines: DataFrame, types: list[str] | None = None, now: datetime | None = None) -> None:
        """N-Triples or N-Quads lines (value) into a pod, merged with what is there: lines without a graph go to the store's own.

        types: only subjects that have one of these types in the lines are taken; the others are left out whole.
        """
        from tessera.sources.rdf import parse_lines

        flat = parse_lines(lines).where("k <> 'b' OR o IS NOT NULL")
        short = lambda c: self.ns.alias(F.col(c))
        rows = flat.select(F.coalesce(short("g"), F.lit(self.context)).alias("c"), short("s").alias("s"), short("p").alias("p"), F.lit(0).alias("pos"), F.when(F.col("k") == "l", "l").otherwise("u").alias("k"), F.when(F.col("k") == "l", F.col("o")).otherwise(short("o")).alias("o"))
        if types is not None:
            wanted = sorted({self.ns.full(t) for t in types})
            rows = written(rows, "lines")  # parsed once, and the join's conditions stay out of the parser
            rows = rows.join(rows.where((F.col("p") == "rdf:type") & self.ns.expand(F.col("o")).isin(wanted)).select("c", "s").distinct(), ["c", "s"], "left_semi")
        self.merge(pod, rows, now)

    def merge(self, pod: str, triples: DataFrame, now: datetime | None = None) -> None:
        """Triples (c, s, p, pos, k, o) added to the descriptions of a pod; equal values count once, those there stay first."""
        at = now or datetime.now(timezone.utc).replace(tzinfo=None)
        table = self.descriptions(pod)
        triples = written(triples.select("c", "s", "p", "pos", "k", "o"), "merged")
        keys = triples.select(F.col("s").alias("r"), "c").distinct()
        old = table.read().join(keys, ["r", "c"], "left_semi") if table.newest() is not None else self.spark.createDataFrame([], DESCRIPTIONS)
        every = PropsPod(old).triples().select("c", "s", "p", "pos", "k", "o").unionByName(triples.select("c", "s", "p", (F.col("pos") + 1_000_000).alias("pos"), "k", "o"))
        change = triples.select("c", "s").withColumn("p", F.lit(None).cast("string"))
        versions = changes.next_versions(old.select("c", F.col("r").alias("s"), "_version", "_cts", "_uts"), change, at)
        rows = from_triples(every).frame.join(versions.withColumnRenamed("s", "r"), ["r", "c"])
        table.replace(rows.select("r", "c", "props", F.col("_version").cast("bigint").alias("_version"), "_cts", "_uts"), keys)

    def replay(self, pod: str, since: datetime | None = None, until: datetime | None = None) -> None:
        """The descriptions of a pod as the completed transactions of the log left them, put over those stored."""
        last = changes.completed(self.log().where(F.col("pod") == pod), since, until).groupBy("r", "c").agg(F.max_by(F.struct("document"), F.struct("end_time", "id")).alias("x"))
        props = F.from_json("x.document", "array<struct<p:string,pos:int,k:string,v:string>>")
        none = F.lit(None)
        rows = last.where("x.document IS NOT NULL").select("r", "c", props.alias("props"), none.cast("bigint").alias("_version"), none.cast("timestamp").alias("_cts"), none.cast("timestamp").alias("_uts"))
        self.descriptions(pod).replace(rows, last.select("r", "c"))


def maintain(store: Store, checkpoint: str, finished: Callable[[int], None] | None = None):
    """A running query that takes changes from the queue of a store and applies each batch, pod by pod."""

    def one(batch: DataFrame, number: int) -> None:
        rows = batch.distinct().persist()
        for pod in store.config.pods:
            mine = rows.where(F.col("pod") == pod).drop("pod")
            if not mine.isEmpty():
                store.apply(mine, pod)
        rows.unpersist()
        if finished:
            finished(number)

    stream = store.spark.readStream.schema("c string, s string, p string, pod string").parquet(f"{store.folder}/queue")
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
