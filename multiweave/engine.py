"""The facade: a catalog of objects, statements over them, and the calls that change them.

Every table is a folder: `current.json` names the newest commit and snapshot; `snapshots/<lsn>` has rows as Parquet;
`log/` has every change as Parquet, one folder a commit, append-only. A write adds its changes to the log and then
replaces `current.json` in one step, so readers see all of it or nothing; they merge what came after the snapshot. A new
snapshot is made when that is a large part of the table. One writer at a time is assumed.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files, statements
from .errors import Denied, DuplicateKey, EngineError, Exists, Expired, InvalidInput, LimitExceeded, NotFound, Unsupported
from .functions import scalar
from .operators import documents, fulltext, geosearch, graph, knn, policy, series, stats, temporal, workload
from .schema import Column, TableSchema
from .sources import foreign
from .streaming import changes, views

KINDS = ("table", "collection", "vectors", "full_text", "series", "graph", "geo", "foreign", "view", "history")
_SQL_KINDS = ("table", "collection", "foreign", "view", "history")
#: A query of one table, with at most a filter of one column by a literal.
_SIMPLE = re.compile(r"(?is)^\s*select\s+(?!distinct\b)[\w\s,*.]+\s+from\s+(\w+)(?:\s+where\s+(\w+)\s*=\s*('(?:[^']|'')*'|[+-]?[\d.]+))?\s*$")
#: Changes since the snapshot that are merged when a table is read are less than this part of it, as 1 / COMPACT.
COMPACT = 4
#: Words of texts whose postings one task sorts, about.
POSTINGS = 2_000_000
_NAME = re.compile(r"^[A-Za-z_]\w*$")


@dataclass
class Table:
    """A handle of a stored table; rows are DataFrames."""

    engine: Engine
    name: str

    @property
    def info(self) -> dict:
        return self.engine._object(self.name, "table")

    @property
    def schema(self) -> TableSchema:
        return TableSchema.from_json(self.info["schema"])

    @property
    def path(self) -> str:
        return f"{self.engine.root}/tables/{self.name}"

    def head(self) -> dict:
        return json.loads(files.read_text(self.engine.spark, f"{self.path}/current.json"))

    def scan(self) -> DataFrame:
        """The rows as they stand: the newest snapshot, with the last change of each key that was changed since."""
        head = self.head()
        rows = self.engine.spark.read.schema(self.schema.struct()).parquet(f"{self.path}/snapshots/{head['base']}")
        if head["base"] == head["lsn"]:
            return rows
        key = self.schema.primary_key
        last = temporal.last_changes(self.log(after=head["base"]), key)
        return rows.join(last.select(key), key, "left_anti").select(self.schema.names).unionByName(last.filter("op = 'upsert'").select(self.schema.names))

    def get(self, key) -> DataFrame:
        return self.scan().filter(F.col(self.schema.primary_key) == F.lit(key))

    def scan_page(self, offset: int, limit: int) -> DataFrame:
        return self.scan().orderBy(self.schema.primary_key).offset(offset).limit(limit)

    def query_eq(self, column: str, value) -> DataFrame:
        return self.scan().filter(F.col(column) == F.lit(value))

    def log(self, *, after: int = 0) -> DataFrame:
        """Changes of the commits after one, up to the newest; what a writer left that died is no commit."""
        now = self.head()["lsn"]
        return self._changes([n for n in files.names(self.engine.spark, f"{self.path}/log") if after < int(n) <= now])

    def committed(self, lsn: int) -> DataFrame:
        """The rows that a commit wrote."""
        return self._changes([f"{lsn:020d}"]).filter("op = 'upsert'").select(self.schema.names)

    def _changes(self, folders: list[str]) -> DataFrame:
        kinds = T.StructType([T.StructField("lsn", T.LongType()), T.StructField("at", T.LongType()), T.StructField("op", T.StringType()), *self.schema.struct().fields])
        if not folders:
            return self.engine.spark.createDataFrame([], kinds)
        return self.engine.spark.read.schema(kinds).parquet(*[f"{self.path}/log/{n}" for n in folders])

    def frame(self, rows) -> DataFrame:
        """Rows as a DataFrame of just the schema: a DataFrame, or tuples in the order of the columns."""
        if isinstance(rows, DataFrame):
            return self.schema.conform(rows)
        return self.engine.spark.createDataFrame(self.schema.check([tuple(r) for r in rows]), self.schema.struct())

    def insert(self, rows) -> int:
        """Adds rows; a key that is there already, or twice among them, is an error and nothing is written."""
        return self._write(self.frame(rows), None, unique=True)

    def upsert(self, rows) -> int:
        """Adds rows in place of those with their keys; of rows with one key the last wins, if they are tuples."""
        if not isinstance(rows, DataFrame):
            at = self.schema.names.index(self.schema.primary_key)
            rows = list({r[at]: tuple(r) for r in rows}.values())
        return self._write(self.frame(rows), None)

    def insert_new(self, rows) -> DataFrame:
        """Adds the rows whose keys are not there, and returns them."""
        key = self.schema.primary_key
        new = self.frame(rows).join(self.scan().select(key), key, "left_anti").dropDuplicates([key]).select(self.schema.names)
        return self.committed(self._write(new, None))

    def delete(self, where) -> int:
        """Deletes the rows that a condition holds for."""
        return self._write(None, self.scan().filter(where))

    def _write(self, new: DataFrame | None, gone: DataFrame | None, *, unique: bool = False) -> int:
        """Commits: new rows replace those of their keys (none may be there, if unique), gone ones leave. Returns the commit's number.

        The changes are written to the log and checked there, so they are computed once; `current.json` then makes them a commit.
        """
        e, key, head, spark = self.engine, self.schema.primary_key, self.head(), self.engine.spark
        for n in files.names(spark, f"{self.path}/log"):
            if int(n) > head["lsn"]:  # a writer died; it was the only one
                files.delete(spark, f"{self.path}/log/{n}")
        staged = None
        if new is not None and e._before.get(self.name):
            staged = f"{self.path}/staged/{time.time_ns()}"
            new.write.parquet(staged)
            new = spark.read.schema(self.schema.struct()).parquet(staged)
            for t in e._before[self.name]:
                new = t(new)
        lsn, at = e._next_lsn(), int(time.time() * 1000)
        folder = f"{self.path}/log/{lsn:020d}"
        change = [x.select(F.lit(lsn).alias("lsn"), F.lit(at).alias("at"), F.lit(op).alias("op"), *self.schema.names) for x, op in ((new, "upsert"), (gone, "delete")) if x is not None]
        (change[0] if len(change) == 1 else change[0].unionByName(change[1])).write.parquet(folder)
        try:
            if new is not None:
                self._check(self.committed(lsn), unique)
        except EngineError:
            files.delete(spark, folder)
            raise
        finally:
            if staged is not None:
                files.delete(spark, staged)
        files.write_text(spark, f"{self.path}/current.json", json.dumps(head | {"lsn": lsn}))
        self._compact()
        e._commit(self.name, lsn)
        return lsn

    def _check(self, rows: DataFrame, unique: bool) -> None:
        key = self.schema.primary_key
        if bad := self.schema.violations(rows).head():
            raise InvalidInput(f"{self.name} does not take {bad.asDict()}")
        if hit := rows.groupBy(key).count().filter("count > 1").head():
            raise (DuplicateKey if unique else InvalidInput)(f"{key} = {hit[0]} comes twice for {self.name}")
        if unique and (hit := rows.select(key).join(self.scan().select(key), key, "left_semi").head()):
            raise DuplicateKey(f"{self.name} has {key} = {hit[0]} already")

    def _compact(self) -> None:
        """Writes a new snapshot once the changes since the last one are a large part of it in bytes, so a row is rewritten a few times at most however many commits there are."""
        spark, head, key = self.engine.spark, self.head(), self.schema.primary_key
        since = sum(files.size(spark, f"{self.path}/log/{n}") for n in files.names(spark, f"{self.path}/log") if head["base"] < int(n) <= head["lsn"])
        if since * COMPACT < files.size(spark, f"{self.path}/snapshots/{head['base']}"):
            return
        rows, path = self.scan(), f"{self.path}/snapshots/{head['lsn']}"
        if head["sorted"]:
            rows = rows.repartitionByRange(F.col(key)).sortWithinPartitions(key)
        rows.write.mode("overwrite").parquet(path)
        files.write_text(spark, f"{self.path}/current.json", json.dumps(head | {"base": head["lsn"]}))


class Engine:
    """A database in a folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._before: dict[str, list[Callable]] = {}
        self._after: dict[str, list[Callable]] = {}
        self._hooks: dict[str, tuple[str, policy.Hook]] = {}
        self._procedures: dict[str, Callable] = {}
        self._views: dict[str, tuple[DataFrame, DataFrame, int]] = {}
        self._grants: dict[str, set[tuple[str, str]]] | None = None
        self.policies = policy.Policies()
        self._samples: list[tuple] = []
        self._tuning: list[tuple] = []
        scalar.register(spark)

    # -------------------------------------------------------------- catalog

    def _path(self, name: str) -> str:
        return f"{self.root}/catalog/{name}.json"

    def _object(self, name: str, kind: str | None = None) -> dict:
        if not files.exists(self.spark, self._path(name)):
            raise NotFound(f"no object {name}")
        o = json.loads(files.read_text(self.spark, self._path(name)))
        if kind is not None and o["kind"] != kind:
            raise NotFound(f"{name} is no {kind}")
        return o

    def _create(self, name: str, kind: str, **more) -> None:
        if not _NAME.match(name):
            raise InvalidInput(f"no name: {name}")
        if files.exists(self.spark, self._path(name)):
            raise Exists(f"{name} is there already")
        files.write_text(self.spark, self._path(name), json.dumps({"name": name, "kind": kind} | more))

    def objects(self) -> list[dict]:
        return [json.loads(files.read_text(self.spark, self._path(n.removesuffix(".json")))) for n in files.names(self.spark, f"{self.root}/catalog") if n.endswith(".json")]

    def _next_lsn(self) -> int:
        path = f"{self.root}/lsn.json"
        lsn = (json.loads(files.read_text(self.spark, path)) if files.exists(self.spark, path) else 0) + 1
        files.write_text(self.spark, path, json.dumps(lsn))
        return lsn

    def last_lsn(self) -> int:
        path = f"{self.root}/lsn.json"
        return json.loads(files.read_text(self.spark, path)) if files.exists(self.spark, path) else 0

    def create_table(self, name: str, schema: TableSchema | None, *, clustered: bool = False) -> Table:
        """A table of a schema, or without one a table of a single string column `value` under a generated key."""
        schema = schema or TableSchema((Column("id", "int", False), Column("value", "str")), "id")
        self._create(name, "table", schema=schema.json())
        t = Table(self, name)
        self.spark.createDataFrame([], schema.struct()).write.parquet(f"{t.path}/snapshots/0")
        files.write_text(self.spark, f"{t.path}/current.json", json.dumps({"lsn": 0, "base": 0, "sorted": clustered, "min_lsn": 0}))
        return t

    def table(self, name: str) -> Table:
        self._object(name, "table")
        return Table(self, name)

    def drop(self, name: str) -> None:
        self._object(name)
        files.delete(self.spark, self._path(name))
        files.delete(self.spark, f"{self.root}/tables/{name}")

    def create_collection(self, name: str, fields: list[documents.DocField]) -> Table:
        """Documents (id, doc as JSON), seen by statements through their fields."""
        t = self.create_table(f"{name}__docs", TableSchema.of("id", id="str!", doc="str!"))
        self._create(name, "collection", docs=t.name, fields=[[f.name, f.path, f.type] for f in fields])
        return t

    def collection(self, name: str) -> Table:
        return Table(self, self._object(name, "collection")["docs"])

    def find(self, name: str, predicate) -> DataFrame:
        return documents.find(self.collection(name).scan(), predicate)

    def create_vector_collection(self, name: str, table: str, *, dim: int, metric: str = "cosine", id_col: str = "id", vec_col: str = "embedding") -> None:
        knn.check([1.0] * dim, dim, metric)
        self._create(name, "vectors", table=table, dim=dim, metric=metric, id_col=id_col, vec_col=vec_col)

    def knn(self, name: str, query: list[float], k: int, *, where=None) -> DataFrame:
        o = self._object(name, "vectors")
        knn.check(query, o["dim"], o["metric"])
        rows = self._frame(o["table"]).filter(knn.valid(F.col(o["vec_col"]), o["dim"], o["metric"]))
        return knn.knn(rows, query, k, id_col=o["id_col"], vec_col=o["vec_col"], metric=o["metric"], where=where)

    def create_full_text_index(self, name: str, table: str, *, id_col: str, text_col: str, language: str = "any") -> None:
        """An index of a table's texts. That of a stored table keeps postings and lengths, and reads changed texts alone when the table has moved on."""
        self._create(name, "full_text", table=table, id_col=id_col, text_col=text_col, language=language)
        if self._object(table)["kind"] == "table":
            self._text_index(name)

    def _text_index(self, name: str) -> tuple[DataFrame, DataFrame]:
        """(postings, stats) of an index as its table stands now; rewritten from the change log if that is newer."""
        o = self._object(name, "full_text")
        at, table, own = f"{self.root}/text/{name}", Table(self, o["table"]), {"id_col": o["id_col"], "text_col": o["text_col"]}
        stored = json.loads(files.read_text(self.spark, f"{at}/current.json")) if files.exists(self.spark, f"{at}/current.json") else None
        part = lambda lsn, kind: self.spark.read.parquet(f"{at}/{lsn}/{kind}")
        lsn = table.head()["lsn"]
        if stored != lsn:
            if stored is None or stored < table.head()["min_lsn"] or o["id_col"] != table.schema.primary_key:
                made = fulltext.postings(table.scan(), **own, unique=o["id_col"] == table.schema.primary_key), fulltext.lengths(table.scan(), **own)
            else:
                last = table.log(after=stored).filter(F.col("lsn") <= lsn).groupBy(o["id_col"]).agg(F.max_by(F.when(F.col("op") == "upsert", F.col(o["text_col"])), "lsn").alias(o["text_col"]))
                made = fulltext.refresh(part(stored, "postings"), part(stored, "lengths"), last, **own, unique=True)
            made[1].write.mode("overwrite").parquet(f"{at}/{lsn}/lengths")
            words = part(lsn, "lengths").agg(F.sum("doc_len")).first()[0] or 0  # as many postings at most
            # by term, so that a search reads the row groups of its terms, and by id, so that those of a frequent term are many tasks'
            ranged = made[0].repartitionByRange(words // POSTINGS + 1, "term", "id").sortWithinPartitions("term", "id")
            ranged.write.mode("overwrite").parquet(f"{at}/{lsn}/postings")
            fulltext.stats_of(part(lsn, "lengths")).write.mode("overwrite").parquet(f"{at}/{lsn}/stats")
            files.write_text(self.spark, f"{at}/current.json", json.dumps(lsn))
        return part(lsn, "postings"), part(lsn, "stats")

    def search(self, name: str, query: str, limit: int = 10) -> DataFrame:
        """(id, score, text) of the best documents."""
        o = self._object(name, "full_text")
        if self._object(o["table"])["kind"] != "table":
            return fulltext.bm25(self._frame(o["table"]), query, id_col=o["id_col"], text_col=o["text_col"], limit=limit)
        best = fulltext.search(*self._text_index(name), query, limit=limit)
        texts = self._frame(o["table"]).select(F.col(o["id_col"]).alias("id"), F.col(o["text_col"]).alias("text"))
        return texts.join(F.broadcast(best), "id").select("id", "score", "text").orderBy(F.desc("score"), "id")  # at most `limit` rows

    def create_time_series(self, name: str, *, retention_ms: int | None = None, bucket_ms: int = 3_600_000) -> Table:
        t = self.create_table(f"{name}__points", TableSchema.of("key", key="str!", series="str!", timestamp_millis="int!", value="float!"))
        self._create(name, "series", points=t.name, retention_ms=retention_ms, bucket_ms=bucket_ms)
        return t

    def insert_points(self, name: str, points: list[tuple[str, int, float]]) -> int:
        """(series, time, value); a point of the same series and time is replaced. Old buckets leave by the retention."""
        o = self._object(name, "series")
        t = Table(self, o["points"])
        lsn = t.upsert([(f"{s}\0{at}", s, at, v) for s, at, v in points])
        if o["retention_ms"] is not None:
            kept = series.retain(t.scan(), o["retention_ms"], o["bucket_ms"])
            gone = t.scan().join(kept.select("key"), "key", "left_anti").select(t.schema.names)
            if not gone.isEmpty():
                lsn = t._write(None, gone)
        return lsn

    def points(self, name: str) -> DataFrame:
        return Table(self, self._object(name, "series")["points"]).scan().drop("key")

    def ts_range(self, name: str, of: str, start: int, end: int) -> DataFrame:
        return series.ts_range(self.points(name), of, start, end)

    def ts_latest(self, name: str) -> DataFrame:
        return series.latest(self.points(name))

    def create_graph(self, name: str) -> Table:
        t = self.create_table(f"{name}__edges", TableSchema.of("key", key="str!", src="str!", label="str!", dst="str!", props="str"))
        self._create(name, "graph", edges=t.name)
        return t

    def add_edges(self, name: str, edges: list[tuple]) -> int:
        """(src, label, dst[, props]); an edge of the same ends and label is replaced."""
        t = Table(self, self._object(name, "graph")["edges"])
        return t.upsert([(json.dumps([s, label, d]), s, label, d, rest[0] if rest else None) for s, label, d, *rest in edges])

    def edges(self, name: str) -> DataFrame:
        return Table(self, self._object(name, "graph")["edges"]).scan()

    def neighbors(self, name: str, src: str, label: str | None = None) -> DataFrame:
        return graph.neighbors(self.edges(name), src, label)

    def k_hop(self, name: str, start: str, label: str | None = None, **limits) -> DataFrame:
        return graph.k_hop(self.edges(name), start, label, **limits)

    def shortest_path(self, name: str, start: str, end: str, label: str | None = None, **limits) -> list | None:
        return graph.shortest_path(self.edges(name), start, end, label, **limits)

    def create_geo_index(self, name: str, table: str, *, id_col: str = "id", lon_col: str = "lon", lat_col: str = "lat") -> None:
        self._create(name, "geo", table=table, id_col=id_col, lon_col=lon_col, lat_col=lat_col)

    def within_radius(self, name: str, lon: float, lat: float, meters: float) -> DataFrame:
        o = self._object(name, "geo")
        return geosearch.within_radius(self._frame(o["table"]), lon, lat, meters, id_col=o["id_col"], lon_col=o["lon_col"], lat_col=o["lat_col"])

    def within_bbox(self, name: str, *box: float) -> DataFrame:
        o = self._object(name, "geo")
        return geosearch.within_bbox(self._frame(o["table"]), *box, id_col=o["id_col"], lon_col=o["lon_col"], lat_col=o["lat_col"])

    def create_foreign_table(self, name: str, t: foreign.ForeignTable) -> None:
        if t.kind == "jdbc":
            foreign.jdbc_options(t)
        self._create(name, "foreign", schema=t.schema.json(), source=t.kind, path=t.path, options=t.options)

    def enable_system_versioning(self, table: str, *, min_lsn: int = 0) -> str:
        """Makes `<table>_history` readable, back to a commit."""
        t = self.table(table)
        files.write_text(self.spark, f"{t.path}/current.json", json.dumps(t.head() | {"min_lsn": min_lsn}))
        self._create(f"{table}_history", "history", table=table)
        return f"{table}_history"

    def create_materialized_view(self, view: views.View) -> None:
        self.table(view.source)
        self._create(view.name, "view", view=json.dumps([view.source, view.key, view.group_by, [list(a) for a in view.aggregates], list(view.where) if view.where else None]))
        rows, groups = views.initial(self.table(view.source).scan(), view)
        self._store_view(view, rows, groups, self.table(view.source).head()["lsn"])

    def _view(self, name: str) -> views.View:
        source, key, by, aggregates, where = json.loads(self._object(name, "view")["view"])
        return views.View(name, source, key, by, tuple((k, c) for k, c in aggregates), tuple(where) if where else None)

    def _store_view(self, view: views.View, rows: DataFrame, groups: DataFrame, lsn: int) -> None:
        base = f"{self.root}/views/{view.name}/{lsn}-{time.time_ns()}"
        rows.write.parquet(f"{base}/rows")
        groups.write.parquet(f"{base}/groups")
        files.write_text(self.spark, f"{self.root}/views/{view.name}/current.json", json.dumps({"at": base, "lsn": lsn}))

    def refresh(self, name: str) -> int:
        """Brings a view up to the newest commit of its source by the changes since; returns that commit."""
        view, head = self._view(name), json.loads(files.read_text(self.spark, f"{self.root}/views/{name}/current.json"))
        t = self.table(view.source)
        now = t.head()["lsn"]
        if now > head["lsn"]:
            state = [self.spark.read.parquet(f"{head['at']}/{x}") for x in ("rows", "groups")]
            later = t.log(after=head["lsn"]).filter(F.col("lsn") <= now)
            self._store_view(view, *views.apply(*state, later, view), now)
        return now

    def read_view(self, name: str) -> DataFrame:
        head = json.loads(files.read_text(self.spark, f"{self.root}/views/{name}/current.json"))
        return views.result(self.spark.read.parquet(f"{head['at']}/groups"), self._view(name))

    # -------------------------------------------------------------- reading

    def _frame(self, name: str, lsn: int | None = None) -> DataFrame:
        """The rows of an object that statements can read, as they are or as they were after a commit."""
        o = self._object(name)
        kind = o["kind"]
        if kind == "table":
            t = Table(self, name)
            if lsn is None:
                return t.scan()
            if lsn < t.head()["min_lsn"]:
                raise Expired(f"commits before {t.head()['min_lsn']} are not kept")
            return temporal.as_of(t.log(), t.schema.primary_key, lsn).select(t.schema.names)
        if kind == "collection":
            docs = self._frame(o["docs"], lsn)
            return documents.project(docs, [documents.DocField(*f) for f in o["fields"]])
        if kind == "foreign":
            return foreign.read(self.spark, foreign.ForeignTable(TableSchema.from_json(o["schema"]), o["source"], o["path"], o["options"]))
        if kind == "view":
            return self.read_view(name)
        if kind == "history":
            t = Table(self, o["table"])
            return temporal.history(t.log(), t.schema.primary_key)
        raise Unsupported(f"{name} cannot be read as a table")

    def grant(self, principal: str, action: str, resource: str) -> None:
        """From the first grant on, principals may do only what they are granted (action: read or write; * for every resource)."""
        self._grants = self._grants or {}
        self._grants.setdefault(principal, set()).add((action, resource))

    def _allow(self, principal: str | None, action: str, resource: str) -> None:
        if principal is None or self._grants is None:
            return
        own = self._grants.get(principal, set())
        if (action, resource) not in own and (action, "*") not in own:
            raise Denied(f"{principal} may not {action} {resource}")

    def _register(self, text: str, principal: str | None, lsn: int | None = None) -> list[str]:
        """The objects that a statement names become views, secured for the principal below the query."""
        used = []
        for o in self.objects():
            if o["kind"] in _SQL_KINDS and re.search(rf"\b{o['name']}\b", text):
                self._allow(principal, "read", o["name"])
                self.policies.secure(self._frame(o["name"], lsn if o["kind"] in ("table", "collection") else None), o["name"], principal).createOrReplaceTempView(o["name"])
                used.append(o["name"])
        return used

    def sql(self, text: str, *, principal: str | None = None) -> DataFrame:
        """Runs a statement, or several parted by semicolons, and returns the last one's rows."""
        out = None
        for statement in statements.split(text):
            began = time.time()
            out = self._run(statement, principal)
            self._sample(statement, began)
        if out is None:
            raise InvalidInput("no statement")
        return out

    def _run(self, text: str, principal: str | None) -> DataFrame:
        kind, parsed = statements.classify(text)
        if kind == "as_of":
            return self.sql_as_of(parsed["query"], principal=principal, **parsed["point"])
        if kind == "insert":
            self._allow(principal, "write", parsed["table"])
            return statements.insert(self, parsed)
        if kind == "call":
            if parsed["name"] not in self._procedures:
                raise NotFound(f"no procedure {parsed['name']}")
            return self._as_rows(self._procedures[parsed["name"]](self, *parsed["arguments"]))
        if kind == "analyze":
            return self.analyze(parsed["table"], full=parsed["full"])
        if kind == "explain":
            return self.explain(parsed["query"], analyze=parsed["analyze"], principal=principal)
        if kind == "unsupported":
            raise Unsupported(f"statements do not {parsed['verb']}; there are calls for it")
        text = statements.rewrite(self, text, parsed)
        self._register(text, principal)
        return self.spark.sql(text)

    def _as_rows(self, value) -> DataFrame:
        return value if isinstance(value, DataFrame) else self.spark.createDataFrame([(None if value is None else str(value),)], "result string")

    def sql_as_of(self, text: str, *, lsn: int | None = None, ts: int | None = None, principal: str | None = None) -> DataFrame:
        """A query over tables as they stood after a commit, or at a time in milliseconds."""
        if (lsn is None) == (ts is None):
            raise InvalidInput("one of lsn and ts")
        if ts is not None:
            logs = [Table(self, o["name"]).log().select("lsn", "at") for o in self.objects() if o["kind"] == "table"]
            every = logs[0] if logs else None
            for x in logs[1:]:
                every = every.unionByName(x)
            if every is None:
                raise NotFound("no commits")
            lsn = temporal.lsn_at(every, ts)
        if not self._register(text, principal, lsn):
            raise NotFound("the query names no table")
        return self.spark.sql(text)

    def explain(self, text: str, *, analyze: bool = False, principal: str | None = None) -> DataFrame:
        """(item, value): the plan, and with analyze the rows and time that it took, for a filter on one column of one table also the rows estimated and examined.

        Those go to the workload, and an estimate that was far off to the tuning log.
        """
        if not re.match(r"\s*(select|with)\b", text, re.I):
            raise Unsupported("only queries are explained")
        self._register(text, principal)
        df = self.spark.sql(text)
        rows = [("plan", df._jdf.queryExecution().toString())]
        if analyze:
            began = time.time()
            n = df.count()
            took = (time.time() - began) * 1000
            rows += [("rows", str(n)), ("milliseconds", str(round(took, 3)))]
            if one := _SIMPLE.match(text):
                rows += self._compared(text, one, n, took)
        return self.spark.createDataFrame(rows, "item string, value string")

    def _compared(self, text: str, one: re.Match, n: int, took: float) -> list[tuple[str, str]]:
        table, column, value = one[1], one[2], statements.literals(one[3])[0] if one[3] else None
        examined = self._frame(table).count()
        self.record_workload(fingerprint=scalar.fingerprint(text), table=table, column=column, latency_ms=took, returned=n, examined=examined)
        out, known = [("rows_examined", str(examined))], self.statistics().get((table, column) if column else (table, None))
        if known is not None:
            guess = round(known["n_rows"] * (stats.eq_selectivity(known, {}, value) if column else 1.0))
            out.append(("rows_estimated", str(guess)))
            if workload.feedback(guess, n):
                self._tuning.append((int(time.time() * 1000), table, column, float(guess), n))
        return out

    def statistics(self) -> dict[tuple[str, str | None], dict]:
        """What ANALYZE kept, by (table, column); by (table, None) that of any column."""
        path = f"{self.root}/statistics.json"
        rows = json.loads(files.read_text(self.spark, path)) if files.exists(self.spark, path) else []
        out = {}
        for table, column, n, nulls, low, high, ndv in rows:
            out[table, column] = out[table, None] = {"n_rows": n, "null_fraction": nulls, "low": low, "high": high, "ndv": ndv}
        return out

    def analyze(self, name: str | None = None, *, full: bool = False) -> DataFrame:
        """Statistics of the columns of one table or of all, over all rows or a sample of 30,000; kept in the catalog folder."""
        names = [name] if name else [o["name"] for o in self.objects() if o["kind"] == "table"]
        out = None
        for n in names:
            t = self.table(n)
            rows, total = t.scan(), None
            if not full and (count := rows.count()) > stats.SAMPLE:
                rows, total = stats.sample(rows, t.schema.primary_key), count
            for c in t.schema.names:
                one = stats.column_stats(rows, c, rows=total).withColumn("table_name", F.lit(n))
                out = one if out is None else out.unionByName(one)
        if out is None:
            raise NotFound("no tables")
        rows = out.select("table_name", "column_name", "n_rows", "null_fraction", "low", "high", "ndv").collect()  # a row for each column
        kept = [[t, c, *x.values()] for (t, c), x in self.statistics().items() if c is not None and t not in names]
        files.write_text(self.spark, f"{self.root}/statistics.json", json.dumps(kept + [list(r) for r in rows]))
        return self.spark.createDataFrame(rows, "table_name string, column_name string, n_rows long, null_fraction double, low string, high string, ndv long")

    # -------------------------------------------------------------- change streams

    def changefeed(self, token: int = 0, *, target: str | None = None, max_commits: int = 1024, markers: bool = True) -> tuple[DataFrame, int, bool]:
        """(events, next token, whether more follow) over all tables."""
        logs = []
        for o in self.objects():
            if o["kind"] == "table":
                t = Table(self, o["name"])
                logs.append(t.log(after=token).select("lsn", "at", "op", F.col(t.schema.primary_key).cast("string").alias("key"), F.lit(t.name).alias("target")))
        if not logs:
            raise NotFound("no tables")
        every = logs[0]
        for x in logs[1:]:
            every = every.unionByName(x)
        return changes.page(every, token, max_commits=max_commits, target=target, markers=markers)

    def create_subscription(self, name: str, *, target: str | None = None) -> None:
        if files.exists(self.spark, f"{self.root}/subscriptions/{name}.json"):
            raise Exists(f"{name} is there already")
        files.write_text(self.spark, f"{self.root}/subscriptions/{name}.json", json.dumps({"target": target, "lsn": 0}))

    def subscription(self, name: str) -> dict:
        if not files.exists(self.spark, f"{self.root}/subscriptions/{name}.json"):
            raise NotFound(f"no subscription {name}")
        return json.loads(files.read_text(self.spark, f"{self.root}/subscriptions/{name}.json"))

    def poll(self, name: str, *, max_commits: int = 1024) -> tuple[DataFrame, int, bool]:
        own = self.subscription(name)
        return self.changefeed(own["lsn"], target=own["target"], max_commits=max_commits)

    def ack(self, name: str, token: int) -> None:
        files.write_text(self.spark, f"{self.root}/subscriptions/{name}.json", json.dumps(self.subscription(name) | {"lsn": token}))

    def continuous_query(self, name: str, table: str, build: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None]):
        """Runs a query over the changes of a table that came since it last ran; its place is kept by a checkpoint. Returns the streaming query."""
        t = self.table(table)
        kinds = t.log().schema
        source = self.spark.readStream.schema(kinds).option("recursiveFileLookup", "true").parquet(f"{t.path}/log")
        return changes.deliver(build(source), sink, checkpoint=f"{self.root}/continuous/{name}")

    # -------------------------------------------------------------- functions, triggers, hooks, procedures

    def register_function(self, name: str, function, returns: str = "string") -> None:
        """A scalar function (a Python function, or a pandas one) that statements can call anywhere."""
        self.spark.udf.register(name, function) if hasattr(function, "evalType") else self.spark.udf.register(name, function, returns)

    def register_sql_function(self, definition: str) -> None:
        """CREATE [TEMPORARY] FUNCTION ... RETURNS ... RETURN ..., scalar or TABLE."""
        self.spark.sql(re.sub(r"^\s*create\s+(or\s+replace\s+)?(temporary\s+)?function", "CREATE OR REPLACE TEMPORARY FUNCTION", definition, flags=re.I))

    def register_procedure(self, name: str, function: Callable) -> None:
        """function(engine, *arguments), called by CALL name(...)."""
        self._procedures[name] = function

    def call(self, name: str, *arguments):
        if name not in self._procedures:
            raise NotFound(f"no procedure {name}")
        return self._procedures[name](self, *arguments)

    def register_trigger(self, table: str, function: Callable[[DataFrame], DataFrame], *, when: str = "before") -> None:
        """before: gets the new rows and returns those to write, or raises; after: gets (engine, commit)."""
        self.table(table)
        if when not in ("before", "after"):
            raise InvalidInput("before or after")
        (self._before if when == "before" else self._after).setdefault(table, []).append(function)

    def register_hook(self, table: str, hook: policy.Hook) -> None:
        """Rows of the table whose last string column breaks the rule stop their commit."""
        t = self.table(table)
        value = [c.name for c in t.schema.columns if c.type == "str" and c.name != t.schema.primary_key][-1]

        def check(rows: DataFrame) -> DataFrame:
            if hook.name in self._hooks and (bad := rows.filter(hook.violates(F.col(t.schema.primary_key), F.col(value))).head()):
                raise InvalidInput(f"{hook.name}: {bad[t.schema.primary_key]} breaks the rule {hook.kind}")
            return rows

        self._hooks[hook.name] = (table, hook)
        self._before.setdefault(table, []).append(check)

    def unregister_hook(self, name: str) -> None:
        self._hooks.pop(name, None)

    def _commit(self, table: str, lsn: int) -> None:
        for f in self._after.get(table, []):
            f(self, lsn)

    # -------------------------------------------------------------- workload

    def _sample(self, text: str, began: float) -> None:
        m = re.search(r"\bfrom\s+(\w+)(?:.*?\bwhere\s+(\w+)\s*=)?", text, re.I | re.S)
        self._samples = [*self._samples[-9_999:], (int(began * 1000), scalar.fingerprint(text), m and m[1], m and m[2], (time.time() - began) * 1000, 0, 0, False)]

    def record_workload(self, *, fingerprint: str, table: str, column: str | None, latency_ms: float, returned: int, examined: int, uses_index: bool = False) -> None:
        self._samples.append((int(time.time() * 1000), fingerprint, table, column, float(latency_ms), returned, examined, uses_index))

    def workload(self) -> DataFrame:
        return self.spark.createDataFrame(self._samples, workload.SAMPLE_SCHEMA)

    def workload_report(self, since: int | None = None) -> DataFrame:
        return workload.report(self.workload(), since)

    def index_advice(self) -> DataFrame:
        made = [(o["name"], TableSchema.from_json(o["schema"]).primary_key) for o in self.objects() if o["kind"] == "table" and Table(self, o["name"]).head()["sorted"]]
        return workload.advice(self.workload(), self.spark.createDataFrame(made, "table_name string, column_name string"))


def sqlstate(error: Exception) -> str:
    return error.sqlstate if isinstance(error, EngineError) else "XX000"


__all__ = ["KINDS", "Engine", "LimitExceeded", "Table", "sqlstate"]
