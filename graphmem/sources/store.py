"""The graph as a log of Parquet deltas.

A commit writes the rows it adds, and a mark for each row it deletes, into a folder of its own for each table it touches, and then one
small manifest that names all folders of all tables.  Readers follow the newest manifest and take the newest row of each uuid, so a batch is seen whole
or not at all, and what it writes is as large as the batch, not as the store.  Manifests are numbered; of two writers that
began from the same one, the second gets a ``Conflict`` and has to begin anew.

Folders are partitioned by ``bucket``, a hash of the group: reads of some groups list and open only their buckets, however many tenants there are, and
any group id will do, the empty one too.  Eight folders of one level are merged into one of the next, newest rows only,
so a read opens about eight folders a level and a row is rewritten once a level.

Paths are Spark's own: any store that Spark writes will do, if its rename doesn't replace a file that is there.
"""

from __future__ import annotations

import json
import uuid as ids

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from graphmem.schema import TABLES

#: Which tables hold edges that touch the nodes of a table, and with which column.
TOUCHING = {
    "entity": [("entity_edge", "source_node_uuid"), ("entity_edge", "target_node_uuid"), ("mentions", "target_node_uuid"), ("has_member", "target_node_uuid")],
    "episode": [("mentions", "source_node_uuid"), ("has_episode", "target_node_uuid"), ("next_episode", "source_node_uuid"), ("next_episode", "target_node_uuid")],
    "community": [("has_member", "source_node_uuid")],
    "saga": [("has_episode", "source_node_uuid")],
}
#: Partitions of a folder, and folders of a level that are merged into one.
BUCKETS, MERGED = 64, 8
#: The column that tells which of several rows of a uuid in one commit is the last.
ORDER = "_pos"

Folder = tuple[int, str, int]  # version, writer, level


class Conflict(RuntimeError):
    """Another writer has committed since this one began; nothing of this commit is seen."""


def last_by_uuid(rows: DataFrame, order: str = ORDER) -> DataFrame:
    """The last row of each uuid in the order of a column, which goes."""
    w = Window.partitionBy("uuid").orderBy(F.col(order).desc())
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", order)


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` replaces rows of equal uuid; ``new`` has each uuid once."""
    return old.join(new.select("uuid"), "uuid", "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def without(rows: DataFrame, gone: DataFrame, column: str = "uuid") -> DataFrame:
    """Rows whose ``column`` isn't a uuid of ``gone``."""
    return rows.join(gone.select(F.col("uuid").alias("_gone")), F.col(column) == F.col("_gone"), "left_anti")


def touching(rows: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is a uuid of ``gone``."""
    return rows.join(gone.select(F.col("uuid").alias("_gone")), F.col(column) == F.col("_gone"), "left_semi")


def bucket(group: Column) -> Column:
    return F.pmod(F.xxhash64(group), F.lit(BUCKETS)).cast("int")


class GraphStore:
    """Reads and writes of the tables in ``schema.TABLES`` under one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # --- Manifests ---------------------------------------------------------------------------------------------

    def _place(self, *parts: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def version(self) -> int:
        """The number of the newest manifest; 0 for none."""
        fs, place = self._place("manifests")
        if not fs.exists(place):
            return 0
        names = (x.getPath().getName() for x in fs.listStatus(place))
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_"))), default=0)

    def manifest(self, version: int | None = None) -> dict[str, list[Folder]]:
        """The folders of each table, oldest first."""
        version = self.version() if version is None else version
        if not version:
            return {}
        text = self.spark.read.text(f"{self.path}/manifests/{version:012d}.json", wholetext=True).first()[0]
        return {name: [tuple(x) for x in folders] for name, folders in json.loads(text).items()}

    def _publish(self, version: int, manifest: dict[str, list[Folder]]) -> None:
        """A file of its own, then a rename that fails if the number is taken."""
        fs, draft = self._place("manifests", f"_{version:012d}-{ids.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        how = gateway.new_array(rename, 1)
        how[0] = rename.NONE
        _, final = self._place("manifests", f"{version:012d}.json")
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, how)
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(final):
                raise Conflict(f"version {version} is taken") from e
            raise

    # --- Reads -------------------------------------------------------------------------------------------------

    def _rows(self, name: str, folders: list[Folder]) -> DataFrame:
        """All rows of some folders, with ``_gone``, ``v`` and ``bucket``."""
        schema = StructType([*TABLES[name].fields, StructField("_gone", BooleanType()), StructField("v", LongType()), StructField("w", StringType()), StructField("bucket", IntegerType())])
        if not folders:
            return self.spark.createDataFrame([], schema).drop("w")
        paths = [f"{self.path}/{name}/v={v}/w={w}" for v, w, _ in folders]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*paths).drop("w")

    def table(self, name: str, groups: list[str] | None = None, version: int | None = None) -> DataFrame:
        """The rows of a table, or of some groups: filters on the bucket and the group come before the newest row of each uuid is taken.

        A uuid never changes its group.
        """
        rows = self._rows(name, folders := self.manifest(version).get(name, []))
        if groups and groups != [""]:
            rows = rows.where(F.col("bucket").isin(*[bucket(F.lit(g)) for g in groups]) & F.col("group_id").isin(groups))
        if len(folders) > 1:
            w = Window.partitionBy("uuid").orderBy(F.col("v").desc())
            rows = rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1")
        return rows.where("not _gone").select(*TABLES[name].names)

    def batch(self, name: str, version: int) -> DataFrame:
        """The rows that one commit added to a table or replaced there, until ``vacuum``."""
        mine = [(v, w, level) for v, w, level in self.manifest(version).get("_by", []) if v == version]
        fs, _ = self._place(name)
        mine = [f for f in mine if fs.exists(self._place(name, f"v={f[0]}", f"w={f[1]}")[1])]
        return self._rows(name, mine).where("not _gone").select(*TABLES[name].names)

    # --- Writes ------------------------------------------------------------------------------------------------

    def commit(self, changed: dict[str, DataFrame], gone: dict[str, DataFrame] | None = None, cleared: tuple[str, ...] = (), since: int | None = None) -> int:
        """Upserts ``changed``, deletes ``gone`` (``uuid, group_id``) and empties the tables ``cleared``, as one version; what is cleared goes first.

        Of rows of equal uuid the last stays, by ``_pos`` or, without that column, in the order of the DataFrame.  ``since``: the version
        that the rows were made from; if another one has been committed since, there is a ``Conflict``.
        """
        before = self.version()
        if since is not None and before != since:
            raise Conflict(f"version {before} was committed after {since}")
        version, writer = before + 1, ids.uuid4().hex[:12]
        manifest = {name: folders for name, folders in self.manifest(before).items() if name not in cleared}
        gone = gone or {}
        for name in {**changed, **gone}:
            parts = [_whole(changed[name], name).withColumn("_gone", F.lit(False))] if name in changed else []
            if name in gone:
                marks = gone[name].select("uuid", "group_id").distinct()
                if name in changed:
                    marks = without(marks, changed[name].select("uuid"))
                parts.append(_layout(marks, name).withColumn("_gone", F.lit(True)))
            rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            self._write(rows, name, version, writer)
            manifest[name] = [*manifest.get(name, []), (version, writer, 0)]
        manifest["_by"] = [(version, writer, 0)]
        manifest = {name: self._merged(name, folders, version, writer) if name in changed or name in gone else folders for name, folders in manifest.items()}
        self._publish(version, manifest)
        return version

    def _write(self, rows: DataFrame, name: str, version: int, writer: str) -> None:
        # A bucket that is large, as that of a tenant with a third of all rows, is split.
        rows.withColumn("bucket", bucket(F.col("group_id"))).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}/v={version}/w={writer}")

    def _merged(self, name: str, folders: list[Folder], version: int, writer: str) -> list[Folder]:
        """Merges the newest folders while the last ``MERGED`` are of one level; marks of deleted rows go once nothing older is left."""
        level = 0
        while len(folders) >= MERGED and all(f[2] == level for f in folders[-MERGED:]):
            older, merged = folders[:-MERGED], folders[-MERGED:]
            w = Window.partitionBy("uuid").orderBy(F.col("v").desc())
            rows = self._rows(name, merged).withColumn("_rank", F.row_number().over(w)).where("_rank = 1")
            rows = rows if older else rows.where("not _gone")
            level += 1
            self._write(rows.drop("_rank", "v", "bucket"), name, version, f"{writer}-{level}")
            folders = [*older, (version, f"{writer}-{level}", level)]
        return folders

    def save(self, since: int | None = None, **rows: DataFrame) -> int:
        """Upserts rows into tables: ``save(entity=df, mentions=df)``; all of them or none."""
        return self.commit(rows, since=since)

    def cascade(self, **gone: DataFrame) -> dict[str, DataFrame]:
        """Rows to delete with the nodes of ``gone`` (``entity=uuids``): themselves and every edge that touches them, ``uuid, group_id`` by table."""
        out: dict[str, list[DataFrame]] = {}
        for name, which in gone.items():
            for table, column in [(name, "uuid"), *TOUCHING.get(name, [])]:
                out.setdefault(table, []).append(touching(self.table(table), which, column).select("uuid", "group_id"))
        return {name: _all(parts) for name, parts in out.items()}

    def delete(self, name: str, gone: DataFrame) -> int:
        """Deletes the rows with the uuids of ``gone``, and every edge that touches them."""
        return self.commit({}, self.cascade(**{name: gone}))

    def clear(self, *names: str) -> int:
        return self.commit({}, cleared=names)

    def vacuum(self, keep: int = 10) -> None:
        """Deletes manifests but the last ``keep``, and the folders that none of those names; no reader or writer may be at an older one."""
        newest = self.version()
        kept = range(max(1, newest - keep + 1), newest + 1)
        named = {(name, v, w) for at in kept for name, folders in self.manifest(at).items() for v, w, _ in folders}
        fs, place = self._place("manifests")
        for x in fs.listStatus(place) if newest else []:
            number = x.getPath().getName().removesuffix(".json")
            if number.isdecimal() and int(number) < kept.start:
                fs.delete(x.getPath(), False)
        for name in TABLES:
            fs, place = self._place(name)
            for v in fs.listStatus(place) if fs.exists(place) else []:
                for w in fs.listStatus(v.getPath()):
                    at = int(v.getPath().getName().removeprefix("v="))
                    if at <= newest and (name, at, w.getPath().getName().removeprefix("w=")) not in named:
                        fs.delete(w.getPath(), True)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _layout(df: DataFrame, name: str) -> DataFrame:
    """``df`` in the layout of a table, a missing column as null."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES[name].fields])


def _whole(df: DataFrame, name: str) -> DataFrame:
    """``df`` in the layout of a table, the last row of each uuid; a null group is the empty one."""
    order = F.col(ORDER) if ORDER in df.columns else F.monotonically_increasing_id()
    rows = df.withColumn(ORDER, order)
    group = F.coalesce(F.col("group_id"), F.lit("")) if "group_id" in df.columns else F.lit("")
    fields = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES[name].fields if f.name != "group_id"]
    return last_by_uuid(rows.select(*fields, group.alias("group_id"), ORDER)).select(*TABLES[name].names)
