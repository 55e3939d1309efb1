"""The stored index: Parquet tables in buckets of files, published a generation at a time.

Every relation is dealt by its file into a fixed number of buckets, and a bucket of a relation is a
folder that is written once and never changed. A catalogue, one small JSON file, says which folder
each bucket is in. Replacing files writes new folders for their buckets alone; the new catalogue is
put in place last, by a rename, so that readers see a generation whole or not at all. Folders that no
catalogue names are removed by `vacuum`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.lookup import table_counts
from .operators.upkeep import without_derived, without_sites_at, without_sites_in
from .schema import RELATIONS, SCHEMA_VERSION

#: What decides the bucket of a row; edges without a site, and ranks, go by themselves.
BUCKET_KEY = {"files": "path", "symbols": "path", "refs": "path", "imports": "path", "import_bindings": "path", "edges": "site_path", "ranks": "symbol_id"}
PER_FILE = ("files", "symbols", "refs", "imports", "import_bindings")


class StoreError(RuntimeError):
    """The store cannot be used as it is."""


class IndexStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root = spark, root.rstrip("/") if "://" in root else f"file://{root.rstrip('/')}"
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p}")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        found = self._load()
        if found is not None and found["meta"].get("schema_version") != str(SCHEMA_VERSION):
            found = None  # another layout is built anew, never migrated
        self.catalogue = found or {"generation": 0, "buckets": buckets, "meta": {"schema_version": str(SCHEMA_VERSION)}, "tables": {r: {} for r in BUCKET_KEY}}

    # files

    def _load(self) -> dict | None:
        at = self._path("_CURRENT")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, catalogue: dict) -> None:
        held = self._load()
        if held is not None and held["generation"] != self.catalogue["generation"] and held["meta"].get("schema_version") == str(SCHEMA_VERSION):
            raise StoreError("another writer has published since this store was opened")
        new = self._path(f"_CURRENT.{uuid.uuid4().hex}")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(catalogue).encode()))
        out.close()
        current = self._path("_CURRENT")
        if self._fs.exists(current):
            self._fs.delete(current, False)
        if not self._fs.rename(new, current):
            raise StoreError("the new generation could not be published")
        self.catalogue = catalogue

    # reading

    @property
    def generation(self) -> int:
        return self.catalogue["generation"]

    @property
    def buckets(self) -> int:
        return self.catalogue["buckets"]

    @property
    def is_empty(self) -> bool:
        return not self.catalogue["tables"]["files"]

    def meta(self, key: str, default: str | None = None) -> str | None:
        return self.catalogue["meta"].get(key, default)

    def table(self, name: str, only: Iterable[int] | None = None) -> DataFrame:
        """A relation; only: these buckets of it."""
        if name == "meta":
            return self.spark.createDataFrame(sorted(self.catalogue["meta"].items()), RELATIONS["meta"])
        wanted = None if only is None else {str(b) for b in only}
        folders = [f"{self.root}/{f}" for b, f in sorted(self.catalogue["tables"][name].items()) if wanted is None or b in wanted]
        if not folders:
            return self.spark.createDataFrame([], RELATIONS[name])
        return self.spark.read.schema(RELATIONS[name]).parquet(*folders)

    def __getattr__(self, name: str) -> DataFrame:
        if name in BUCKET_KEY:
            return self.table(name)
        raise AttributeError(name)

    def snapshot(self) -> dict[str, DataFrame]:
        """All relations of this generation, to be read when they are needed."""
        return {name: self.table(name) for name in BUCKET_KEY}

    def of_paths(self, name: str, paths: Iterable[str]) -> DataFrame:
        """Rows of a few files: only their buckets are read."""
        paths = list(paths)
        return self.table(name, self.buckets_of(paths)).filter(F.col(BUCKET_KEY[name]).isin(paths))

    def counts(self) -> DataFrame:
        return table_counts({n: self.table(n) for n in ("files", "symbols", "edges", "refs", "imports")})

    def languages(self) -> DataFrame:
        return self.table("files").groupBy("language").agg(F.count("*").alias("files"))

    def bucket(self, column) -> F.Column:
        return F.when(column.isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(column), F.lit(self.buckets))).cast("int")

    def buckets_of(self, paths: Iterable[str]) -> set[int]:
        rows = self.spark.createDataFrame([(p,) for p in paths], "path string")
        return {r[0] for r in rows.select(self.bucket(F.col("path"))).distinct().collect()}

    # writing

    def transaction(self) -> Transaction:
        return Transaction(self)

    def set_meta(self, key: str, value: str) -> None:
        with self.transaction() as t:
            t.meta[key] = value

    def bump_generation(self) -> None:
        with self.transaction():
            pass

    def reset(self) -> None:
        """Empty all relations; the layout's version stays."""
        with self.transaction() as t:
            for name in BUCKET_KEY:
                t.tables[name] = {}
            t.meta = {"schema_version": str(SCHEMA_VERSION)}

    def vacuum(self) -> int:
        """Remove folders that the current generation does not name; how many."""
        used = {f for table in self.catalogue["tables"].values() for f in table.values()}
        gone = 0
        for name in BUCKET_KEY:
            base = self._path(f"tables/{name}")
            for written in self._fs.listStatus(base) if self._fs.exists(base) else ():
                for part in self._fs.listStatus(written.getPath()):
                    folder = part.getPath()
                    if folder.getName().startswith("bucket=") and f"tables/{name}/{written.getPath().getName()}/{folder.getName()}" not in used:
                        self._fs.delete(folder, True)
                        gone += 1
        return gone


class Transaction:
    """Changes that are published together at the end, or not at all."""

    def __init__(self, store: IndexStore):
        self.store = store
        self.tables = {n: dict(t) for n, t in store.catalogue["tables"].items()}
        self.meta = dict(store.catalogue["meta"])
        self.written: list[str] = []

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is None:
            now = self.store.catalogue
            self.store._publish({"generation": now["generation"] + 1, "buckets": now["buckets"], "meta": self.meta, "tables": self.tables})
            return
        for folder in self.written:
            self.store._fs.delete(self.store._path(folder), True)

    def write(self, name: str, rows: DataFrame, only: Iterable[int] | None = None) -> None:
        """Replace a relation, or these buckets of it, by rows (of these buckets)."""
        only = None if only is None else set(only)
        folder = f"tables/{name}/{self.store.generation + 1}-{uuid.uuid4().hex[:8]}"
        self.written.append(folder)
        dealt = rows.select(*RELATIONS[name].names).withColumn("bucket", self.store.bucket(F.col(BUCKET_KEY[name])))
        if only is not None:
            dealt = dealt.filter(F.col("bucket").isin(sorted(only)))
        dealt.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.store.root}/{folder}")
        path = self.store._path(folder)
        found = [s.getPath().getName() for s in self.store._fs.listStatus(path)]
        new = {n.split("=")[1]: f"{folder}/{n}" for n in found if n.startswith("bucket=")}
        kept = {} if only is None else {b: f for b, f in self.tables[name].items() if int(b) not in only}
        self.tables[name] = kept | new

    def read(self, name: str, only: Iterable[int] | None = None) -> DataFrame:
        """A relation as this transaction has left it."""
        wanted = None if only is None else {str(b) for b in only}
        folders = [f"{self.store.root}/{f}" for b, f in sorted(self.tables[name].items()) if wanted is None or b in wanted]
        return self.store.spark.read.schema(RELATIONS[name]).parquet(*folders) if folders else self.store.spark.createDataFrame([], RELATIONS[name])

    def put_files(self, new: dict[str, DataFrame], paths: DataFrame) -> None:
        """Replace everything that is held for the paths (path) by the rows of new; paths without rows are gone."""
        buckets = {r[0] for r in paths.select(self.store.bucket(F.col("path"))).distinct().collect()}
        gone = paths.select("path").distinct()
        for name in PER_FILE:
            kept = self.read(name, buckets).join(gone, "path", "left_anti")
            rows = kept.unionByName(new[name].select(*RELATIONS[name].names)) if name in new else kept
            self.write(name, rows, buckets)

    def remove_files(self, paths: DataFrame) -> None:
        """Files go with their symbols, references, imports, and the edges that they are evidence of."""
        self.put_files({}, paths)
        self.delete_edges_in(paths)

    def replace_edges(self, edges: DataFrame) -> None:
        self.write("edges", edges)

    def add_edges(self, edges: DataFrame) -> None:
        buckets = {r[0] for r in edges.select(self.store.bucket(F.col("site_path"))).distinct().collect()}
        self.write("edges", self.read("edges", buckets).unionByName(edges.select(*RELATIONS["edges"].names)), buckets)

    def delete_edges_in(self, paths: DataFrame) -> None:
        buckets = {r[0] for r in paths.select(self.store.bucket(F.col("path"))).distinct().collect()}
        self.write("edges", without_sites_in(self.read("edges", buckets), paths), buckets)

    def delete_edges_at(self, places: DataFrame) -> None:
        buckets = {r[0] for r in places.select(self.store.bucket(F.col("path"))).distinct().collect()}
        self.write("edges", without_sites_at(self.read("edges", buckets), places), buckets)

    def delete_derived_edges(self) -> None:
        self.write("edges", without_derived(self.read("edges", [-1])), [-1])

    def replace_ranks(self, ranks: DataFrame) -> None:
        self.write("ranks", ranks)
