"""Stored catalogs and change logs, on Parquet in shared storage."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwright import schema as sc
from shelfwright.catalog import Catalog
from shelfwright.operators.changes import apply_changes
from shelfwright.operators.fields import PRICE_FIELDS, FieldRegistry


_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a local session without one gets a temporary folder:
    on a cluster, executors could not reach it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    application = spark.conf.get("spark.app.id", "")
    if application not in _local_dirs:
        _local_dirs[application] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_dirs[application]


def snapshot(frame: DataFrame, name: str = "snapshot") -> DataFrame:
    """Write a frame and read it back: it no longer follows its inputs, costs nothing to reuse,
    survives lost executors, and its size is known when joins are planned."""
    path = f"{shared_dir(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


# How each table is laid out: rows that are read together lie together, so that file and row-group
# statistics prune by scope, metadata key or taxonomy. The trailing columns give every range of
# a popular key somewhere to be cut.
CLUSTERING = {
    "objects": ("object_type", "object_id"),
    "meta": ("meta_key", "object_id", "meta_value"),
    "terms": ("taxonomy", "term_id"),
    "object_terms": ("taxonomy", "term_id", "object_id"),
}
SCHEMAS = {
    "objects": sc.OBJECTS,
    "meta": sc.META,
    "terms": sc.TERMS,
    "object_terms": sc.OBJECT_TERMS,
}
BUCKETED = ("objects", "meta", "object_terms")


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to a folder has been committed."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


class CatalogStore:
    """Catalog versions under one root folder. A version is written once and never changed. It counts from
    the moment its marker is there, which is written last: a job that fails half-way leaves no version, only the
    ones before it, and can be run again."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark = spark
        self._root = root.rstrip("/")

    def write(self, catalog: Catalog, version: str, partitions: int | None = None) -> Catalog:
        """Clustered layout, cut into ranges by sampled bounds, so it holds for skewed keys."""
        self._begin(version)
        for name, columns in CLUSTERING.items():
            frame: DataFrame = getattr(catalog, name)
            by = [F.col(c) for c in columns]
            ranged = (
                frame.repartitionByRange(partitions, *by) if partitions else frame.repartitionByRange(*by)
            )
            ranged.sortWithinPartitions(*by).write.mode("overwrite").parquet(self._path(version, name))
        self._finish(version)
        return self.open(version)

    def exists(self, version: str) -> bool:
        return is_complete(self._spark, self._path(version, "complete"))

    def _begin(self, version: str) -> None:
        if self.exists(version):
            raise ValueError(f"catalog version {version} is already written")

    def _finish(self, version: str) -> None:
        self._spark.range(1).write.mode("overwrite").parquet(self._path(version, "complete"))

    def _check(self, version: str) -> None:
        if not self.exists(version):
            raise ValueError(f"there is no complete catalog version {version}")

    def open(self, version: str) -> Catalog:
        self._check(version)
        tables = {
            name: self._spark.read.schema(SCHEMAS[name]).parquet(self._path(version, name))
            for name in CLUSTERING
        }
        return Catalog(**tables)

    def write_bucketed(self, catalog: Catalog, version: str, buckets: int) -> Catalog:
        """Bucketed by object, so that joins and aggregations on ``object_id`` need no shuffle.
        A bucket is one task: choose this only where no single object owns much of a table."""
        self._begin(version)
        for name in CLUSTERING:
            frame: DataFrame = getattr(catalog, name)
            path = self._path(version, name)
            if name not in BUCKETED:
                frame.write.mode("overwrite").parquet(path)
                continue
            (
                frame.repartition(buckets, "object_id")
                .write.format("parquet")
                .bucketBy(buckets, "object_id")
                .sortBy(*dict.fromkeys(("object_id", *CLUSTERING[name])))
                .option("path", path)
                .mode("overwrite")
                .saveAsTable(self._table(version, name))
            )
        self._finish(version)
        return self.open_bucketed(version, buckets)

    def open_bucketed(self, version: str, buckets: int) -> Catalog:
        """Open a bucketed version, registering its tables where this session has not."""
        self._check(version)
        tables = {}
        for name in CLUSTERING:
            if name not in BUCKETED:
                tables[name] = self._spark.read.schema(SCHEMAS[name]).parquet(self._path(version, name))
                continue
            table = self._table(version, name)
            if not self._spark.catalog.tableExists(table):
                columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in SCHEMAS[name])
                ordering = ", ".join(dict.fromkeys(("object_id", *CLUSTERING[name])))
                self._spark.sql(
                    f"CREATE TABLE {table} ({columns}) USING parquet "
                    f"CLUSTERED BY (object_id) SORTED BY ({ordering}) INTO {buckets} BUCKETS "
                    f"LOCATION '{self._path(version, name)}'"
                )
            tables[name] = self._spark.table(table)
        return Catalog(**tables)

    def _path(self, version: str, name: str) -> str:
        return f"{self._root}/{version}/{name}"

    def _table(self, version: str, name: str) -> str:
        return "".join(c if c.isalnum() else "_" for c in f"catalog_{version}_{name}").lower()


class PartedStore:
    """Catalog versions that share what an operation has not touched.

    Metadata lies in parts, by the type of its owner and a hash of its key, and objects by their type. A version is a list of parts and the
    version whose files hold each. An operation writes the parts of its keys and takes the others over, so its cost follows what it
    changes, not the catalog. Parts are written once; the list, with its marker, comes last."""

    _PART = "table string, scope string, part int, version string"

    def __init__(self, spark: SparkSession, root: str, parts: int = 32):
        self._spark = spark
        self._root = root.rstrip("/")
        self._parts = parts

    def exists(self, version: str) -> bool:
        return is_complete(self._spark, f"{self._root}/{version}/parts")

    def parts(self, version: str) -> list[tuple[str, str, int, str]]:
        """(table, scope, part, version of the files): at most two lists of parts per table."""
        if not self.exists(version):
            raise ValueError(f"there is no complete catalog version {version}")
        rows = self._spark.read.schema(self._PART).parquet(f"{self._root}/{version}/parts").collect()
        return sorted(tuple(r) for r in rows)

    def write(self, catalog: Catalog, version: str) -> Catalog:
        """A whole catalog. Owners of metadata are looked up unless the catalog knows them; rows without one are kept."""
        self._begin(version)
        owned = catalog.owned_meta
        if owned is None:
            types = catalog.objects.select(F.col("object_id").alias("__id"), "object_type")
            owned = catalog.meta.join(types, F.col("object_id") == F.col("__id"), "left").drop("__id")
        listed = self._write(owned, "meta", version) + self._write(catalog.objects, "objects", version)
        for name in ("terms", "object_terms"):
            getattr(catalog, name).write.mode("overwrite").parquet(f"{self._root}/{version}/{name}")
            listed.append((name, "", 0, version))
        return self._finish(listed, version)

    def apply(self, base: str, changes: DataFrame, fields: Sequence[str], registry: FieldRegistry, version: str) -> Catalog:
        """The version that a (written) change set makes of another: only parts that it can touch are read and written."""
        self._begin(version)
        known = self.parts(base)
        targets = [registry.get(f) for f in fields]
        keys = {f.meta_key for f in targets if f.meta_key is not None}
        scopes = [r[0] for r in changes.select("object_type").distinct().collect()]
        touched = {("meta", s, self._part_of(k)) for s in scopes for k in keys}
        listed = []
        rewritten = None
        for scope in scopes if keys else ():
            few = self._open([p for p in known if p[0] == "meta" and p[:3] in touched and p[1] == scope])
            own = apply_changes(few, changes.where(F.col("object_type") == scope), [f.key for f in targets if f.meta_key is not None], registry)
            rows = own.meta.withColumn("object_type", F.lit(scope))
            rewritten = rows if rewritten is None else rewritten.unionByName(rows)
        if rewritten is not None:
            listed += self._write(rewritten, "meta", version)
        if any(f.column is not None or f.key in PRICE_FIELDS for f in targets):
            touched |= {("objects", s, 0) for s in scopes}
            whole = self._open([p for p in known if p[0] != "objects" or p[:3] in touched])
            listed += self._write(apply_changes(whole, changes, fields, registry).objects, "objects", version)
        return self._finish(listed + [p for p in known if p[:3] not in touched], version)

    def open(self, version: str) -> Catalog:
        return self._open(self.parts(version))

    def _open(self, parts: Sequence[tuple[str, str, int, str]]) -> Catalog:
        owned = self._read("meta", parts)
        others = {name: self._read(name, parts) for name in ("objects", "terms", "object_terms")}
        return Catalog(meta=owned.select(*sc.META.fieldNames()), owned_meta=owned, **others)

    def _read(self, table: str, parts: Sequence[tuple[str, str, int, str]]) -> DataFrame:
        columns = T.StructType([*sc.META, T.StructField("object_type", T.StringType())]) if table == "meta" else SCHEMAS[table]
        paths = [self._folder(*p) for p in parts if p[0] == table]
        if not paths:
            return self._spark.createDataFrame([], columns)
        return self._spark.read.schema(columns).parquet(*paths)

    def _folder(self, table: str, scope: str, part: int, version: str) -> str:
        own = f"/__scope={scope}/__part={part}" if scope else ""
        return f"{self._root}/{version}/{table}{own}"

    def _part_of(self, key: str) -> int:
        return zlib.crc32(key.encode()) % self._parts

    def _write(self, rows: DataFrame, table: str, version: str) -> list[tuple[str, str, int, str]]:
        path = f"{self._root}/{version}/{table}"
        part = (F.crc32(F.coalesce("meta_key", F.lit("")).cast("binary")) % self._parts).cast("int") if table == "meta" else F.lit(0)
        by = [F.col(c) for c in ("__scope", "__part", *CLUSTERING[table])]
        # Adaptive execution divides parts that are large and joins those that are small. The scope's name is told from the row
        # where it arrives, so that it is not moved along.
        dealt = rows.withColumn("__part", part).hint("rebalance", F.col("object_type"), F.col("__part"))
        dealt = dealt.withColumn("__scope", F.coalesce("object_type", F.lit("none")))
        dealt.sortWithinPartitions(*by).write.mode("overwrite").partitionBy("__scope", "__part").parquet(path)
        pattern = self._spark._jvm.org.apache.hadoop.fs.Path(f"{path}/__scope=*/__part=*")
        found = pattern.getFileSystem(self._spark._jsc.hadoopConfiguration()).globStatus(pattern)
        folders = [f.getPath() for f in found]
        return [(table, f.getParent().getName().split("=")[1], int(f.getName().split("=")[1]), version) for f in folders]

    def _begin(self, version: str) -> None:
        if self.exists(version):
            raise ValueError(f"catalog version {version} is already written")

    def _finish(self, listed: Sequence[tuple[str, str, int, str]], version: str) -> Catalog:
        rows = self._spark.createDataFrame(list(listed), self._PART)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self._root}/{version}/parts")
        return self.open(version)


class ChangeLog:
    """Change sets, one folder per operation and stage. Each is written once: what an earlier run
    completed stands, and what it left half-written is replaced."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark = spark
        self._root = root.rstrip("/")

    def write_frozen(self, rows: DataFrame, operation_id: int) -> DataFrame:
        """Keep an operation's targets. They are chosen once: freezing again is an error."""
        path = self._path("frozen", operation_id)
        if is_complete(self._spark, path):
            raise ValueError(f"operation {operation_id} is already frozen")
        rows.drop("operation_id").write.mode("overwrite").parquet(path)
        return self.frozen(operation_id)

    def write_settled(self, rows: DataFrame, operation_id: int) -> DataFrame:
        """Keep an operation's outcome. If it has one already, that is returned and ``rows`` is
        not even computed, so that running an operation again cannot apply it twice."""
        path = self._path("settled", operation_id)
        if not is_complete(self._spark, path):
            rows.drop("operation_id").write.mode("overwrite").parquet(path)
        return self.settled(operation_id)

    def frozen(self, operation_id: int) -> DataFrame:
        return self._one("frozen", operation_id)

    def settled(self, operation_id: int) -> DataFrame:
        return self._one("settled", operation_id)

    def all_settled(self) -> DataFrame:
        """The whole log; a filter on ``operation_id`` selects folders."""
        return self._spark.read.schema(sc.CHANGES).parquet(f"{self._root}/settled").select(*sc.CHANGE_COLUMNS)

    def _one(self, stage: str, operation_id: int) -> DataFrame:
        columns = T.StructType([f for f in sc.CHANGES if f.name != "operation_id"])
        rows = self._spark.read.schema(columns).parquet(self._path(stage, operation_id))
        return rows.withColumn("operation_id", F.lit(operation_id).cast("bigint")).select(*sc.CHANGE_COLUMNS)

    def _path(self, stage: str, operation_id: int) -> str:
        return f"{self._root}/{stage}/operation_id={operation_id}"


class LogArchive:
    """Change sets of any number of operations in few folders: dealt to buckets by operation, sorted by operation and object
    inside, with Bloom filters on both. Reading one operation opens its bucket and in it the row groups that can hold it.

    Rows come in generations, each written once; of an operation that was added again only the first counts."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self._spark = spark
        self._path = path.rstrip("/")
        self._buckets = buckets

    def _bucket(self, operation_id: Column) -> Column:
        return F.pmod(F.xxhash64(operation_id), F.lit(self._buckets).cast("bigint")).cast("int")

    def generations(self) -> list[int]:
        """Complete generations; there are as many as ``add`` was called since the last ``compact``."""
        jvm = self._spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self._path)
        system = root.getFileSystem(self._spark._jsc.hadoopConfiguration())
        if not system.exists(root):
            return []
        found = [int(f.getPath().getName()) for f in system.listStatus(root) if f.isDirectory()]
        return sorted(g for g in found if is_complete(self._spark, f"{self._path}/{g}"))

    def add(self, rows: DataFrame) -> None:
        """Rows of whole operations. Those of operations already here are left out, so adding may be repeated."""
        known = self.generations()
        if known:
            # Known ids, each once, are hashed by partition, so that the rows need not be sorted to be left out.
            there = self._read(known).select("operation_id").distinct().hint("shuffle_hash")
            rows = rows.join(there, "operation_id", "left_anti")
        self._write(rows, known[-1] + 1 if known else 0)

    def _write(self, rows: DataFrame, generation: int) -> None:
        by = [F.col("bucket"), F.col("operation_id"), F.col("object_id")]
        dealt = rows.select(*sc.CHANGE_COLUMNS, self._bucket(F.col("operation_id")).alias("bucket")).hint("rebalance", F.col("bucket")).sortWithinPartitions(*by)
        filters = {f"parquet.bloom.filter.enabled#{c}": "true" for c in ("operation_id", "object_id")}
        dealt.write.mode("overwrite").options(**filters).partitionBy("bucket").parquet(f"{self._path}/{generation}")

    def _read(self, generations: Sequence[int]) -> DataFrame:
        schema = T.StructType([*sc.CHANGES, T.StructField("bucket", T.IntegerType())])
        frames = [self._spark.read.schema(schema).parquet(f"{self._path}/{g}") for g in generations]
        if not frames:
            return self._spark.createDataFrame([], schema)
        return reduce(DataFrame.unionByName, frames)

    def rows(self, operation_id: int | None = None) -> DataFrame:
        """The whole log, or one operation's."""
        found = self._read(self.generations())
        if operation_id is not None:
            bucket = self._spark.range(1).select(self._bucket(F.lit(operation_id).cast("bigint"))).first()[0]
            found = found.where((F.col("bucket") == bucket) & (F.col("operation_id") == operation_id))
        return found.select(*sc.CHANGE_COLUMNS)

    def compact(self, expired: DataFrame | None = None) -> None:
        """All generations as one, without the operations in ``expired`` (operation_id): how retention frees space. The
        generations it was made from go once it is complete; a lost job leaves them as they were."""
        known = self.generations()
        if not known or (len(known) == 1 and expired is None):
            return
        rows = self._read(known)
        if expired is not None:
            rows = rows.join(expired.select("operation_id"), "operation_id", "left_anti")
        self._write(rows, known[-1] + 1)
        jvm = self._spark._jvm
        for g in known:
            old = jvm.org.apache.hadoop.fs.Path(f"{self._path}/{g}")
            old.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(old, True)


class OperationLog:
    """Operation rows as appended versions; the newest version of a row is the row."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark = spark
        self._path = path

    def append(self, rows: DataFrame, version: int) -> None:
        stamped = rows.select(*sc.OPERATIONS.fieldNames(), F.lit(version).cast("bigint").alias("version"))
        stamped.write.mode("append").parquet(self._path)

    def read(self) -> DataFrame:
        columns: Sequence[str] = sc.OPERATIONS.fieldNames()
        versions = self._spark.read.schema(
            T.StructType([*sc.OPERATIONS, T.StructField("version", T.LongType())])
        ).parquet(self._path)
        newest = versions.groupBy("id").agg(
            F.max_by(F.struct(*columns), "version").alias("row")
        )
        return newest.select("row.*")
