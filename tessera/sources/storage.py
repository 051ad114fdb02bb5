"""Tables of an index in a folder that driver and executors share."""

from __future__ import annotations

import json
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset, a temporary one on a single machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """df written to the shared folder, in files of file_rows rows at most if given, and read back, for what several parts
    of a plan read."""
    path = work_folder(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession, *used: DataFrame) -> None:
    """Delete the folders of `stored` tables that no plan will read again, and let Spark's cleaner drop the shuffle files of
    plans that are over: it learns of them when the driver collects garbage, by itself every half hour."""
    for df in used:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            Folder(spark, path).delete("")
    spark._jvm.System.gc()


class Folder:
    """Names in a folder, wherever Spark can write: only listing, renaming and deleting go through Hadoop's file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path
        self.fs = self.at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(name))) if self.fs.exists(self.at(name)) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> None:
        """The file appears whole under its name, or an error says that there is one already."""
        held = f"_{uuid.uuid4().hex}"
        out = self.fs.create(self.at(held), False)
        out.write(bytearray(text.encode()))
        out.close()
        if self.fs.exists(self.at(name)) or not self.fs.rename(self.at(held), self.at(name)):
            self.fs.delete(self.at(held), False)
            raise RuntimeError(f"{self.path}/{name} was written by someone else meanwhile")

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


class Table:
    """Rows by key, kept as a log of commits in a folder.

    Rows lie in a fixed number of parts by the hash of one column. A commit writes files of the parts that its rows touch,
    with a mark for keys that go, and then a manifest: the folders that make up each part from then on, under the next
    version's name. Nothing that is written is changed, so a reader keeps what its version names, a failed run leaves the
    last version whole, and whoever opens the folder finds the newest manifest. Reads merge the folders of a part by key:
    the latest row of a key stands (`last`), or figures add up (`sum`, keys whose sums are all 0 are gone) or take their
    maximum (`max`). `compact` rewrites parts of several folders into one; `vacuum` deletes what no kept version names. A
    commit with a transaction (a name and a number that grows) that was made before does nothing.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: tuple[str, ...] = ("document_id",), parts: int = 64, by: str | None = None, merge: str = "last"):
        self.spark, self.path, self.schema, self.key, self.parts, self.by, self.merge = spark, path, schema, key, parts, by or key[0], merge
        self.columns = [c.split()[0] for c in schema.split(", ")]
        self.kinds = dict(c.split() for c in schema.split(", "))
        self.refresh()

    def refresh(self) -> None:
        """Look for the newest version."""
        self.manifests = Folder(self.spark, f"{self.path}/manifests")
        found = [int(n[1:-5]) for n in self.manifests.names() if n.startswith("v") and n.endswith(".json")]
        self._open(max(found, default=0))

    def _open(self, version: int) -> None:
        self.version, self.content, self.folders, self.done = version, 0, {}, {}
        if version:
            held = json.loads(self.manifests.read(f"v{version}.json"))
            self.content, self.folders, self.done = held["content"], {int(k): v for k, v in held["parts"].items()}, held["done"]

    def before(self, content: int) -> Table:
        """The table as it was when so many commits had been made."""
        held = Table(self.spark, self.path, self.schema, self.key, self.parts, self.by, self.merge)
        for version in range(self.version, -1, -1):
            held._open(version)
            if held.content <= content:
                break
        return held

    def _part(self, column) -> F.Column:
        return F.pmod(F.hash(column), F.lit(self.parts))

    def _files(self, parts: list[int]) -> DataFrame | None:
        paths = [f"{self.path}/data/_commit={folder}/_part={k}" for k in parts for folder in self.folders[k]]
        if not paths:
            return None
        return self.spark.read.schema(f"{self.schema}, _gone boolean, _commit string, _part int").option("basePath", f"{self.path}/data").parquet(*paths)

    def _merged(self, parts: list[int]) -> list[DataFrame]:
        """Rows with _part of the parts: as they are where one folder makes up a part, else merged by key."""
        plain = self._files([k for k in parts if len(self.folders[k]) == 1])
        layered = self._files([k for k in parts if len(self.folders[k]) > 1])
        rest = [c for c in self.columns if c not in self.key]
        out = []
        if plain is not None:
            out.append(plain.where("NOT _gone") if self.merge == "last" else plain)
        if layered is not None:
            keys = [*self.key, "_part"]
            if self.merge == "last":
                if any(not k.startswith(("bigint", "int", "double")) for k in (self.kinds[c] for c in rest)):
                    single, layered = self._standing(layered, keys)
                    out.append(single)
                last = layered.groupBy(*keys).agg(F.max_by(F.struct(*rest, "_gone"), "_commit").alias("_r"))
                out.append(last.select(*keys, "_r.*").where("NOT _gone"))
            else:
                out.append(layered.groupBy(*keys).agg(*[getattr(F, self.merge)(c).alias(c) for c in rest]))
        if self.merge == "sum":
            out = [x.where(" OR ".join(f"{c} <> 0" for c in rest)) for x in out]
        return [x.select(*self.columns, "_part") for x in out]

    def _standing(self, rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
        """(rows that stand as they are, rows to be merged) of layered rows, so that what is long in them is not shuffled.

        Keys alone are grouped first. A row that a bitmap of each key's latest commit does not have is not the latest one and
        goes; of what passes, only keys that are there more than once are left to merge. Bitmaps let some rows too many pass,
        which are merged; so a crowded one costs time and changes nothing.
        """
        from tessera.functions import arrays as A

        latest = A.bitmap(rows.groupBy(*keys).agg(F.max("_commit").alias("_commit")).select(F.xxhash64(*keys, "_commit").alias("h")), "h")
        passed = rows.where(A.among(latest)(F.xxhash64(*keys, "_commit")))
        again = A.bitmap(passed.groupBy(*keys).count().where("count > 1").select(F.xxhash64(*keys).alias("h")), "h")
        if not again.any():
            return passed.where("NOT _gone"), rows.where("false")
        several = A.among(again)(F.xxhash64(*keys))
        return passed.where(~several & ~F.col("_gone")), passed.where(several)

    def read(self, value: int | None = None, parts: list[int] | None = None) -> DataFrame:
        """All rows, or those with one value of the column that the parts go by, of whose part alone files are read; or
        those of some parts."""
        found = self._merged(sorted(k for k in self.folders if parts is None or k in parts))
        if not found:
            return self.spark.createDataFrame([], self.schema)
        rows = reduce(DataFrame.unionByName, found)
        if value is not None:
            wanted = F.lit(value).cast(self.kinds[self.by])
            rows = rows.where((F.col("_part") == self._part(wanted)) & (F.col(self.by) == wanted))
        return rows.drop("_part")

    def read_for(self, rows: DataFrame) -> DataFrame:
        """The rows whose parts rows (with the column that the parts go by) touch."""
        touched = rows.select(self._part(F.col(self.by)).alias("k")).distinct().collect()  # no more than there are parts
        return self.read(parts=[r.k for r in touched])

    def _write(self, rows: DataFrame) -> tuple[str, list[int]]:
        """Write rows (with _gone) as one folder; its name, and the parts that it has."""
        folder = f"{self.version + 1:08d}-{uuid.uuid4().hex}"
        cut = rows.select(*self.columns, "_gone", self._part(F.col(self.by)).alias("_part"))
        # rows go together by part, and a part of many rows is cut, so that the tasks follow the rows and not the parts
        cut.hint("rebalance", "_part").write.partitionBy("_part").parquet(f"{self.path}/data/_commit={folder}")
        names = Folder(self.spark, f"{self.path}/data/_commit={folder}").names()
        return folder, [int(n.removeprefix("_part=")) for n in names if n.startswith("_part=")]

    def _publish(self, folders: dict[int, list[str]], done: dict[str, int], new: int = 1) -> None:
        held = {"content": self.content + new, "parts": {k: v for k, v in folders.items() if v}, "done": done}
        self.manifests.write_new(f"v{self.version + 1}.json", json.dumps(held))
        self.version, self.content, self.folders, self.done = self.version + 1, self.content + new, held["parts"], done

    def committed(self, transaction: tuple[str, int] | None) -> bool:
        return transaction is not None and self.done.get(transaction[0], -1) >= transaction[1]

    def commit(self, upserts: DataFrame | None, deletes: DataFrame | None = None, transaction: tuple[str, int] | None = None) -> bool:
        """Add rows, of which each key has one, and marks for keys that go; False where the transaction was made before."""
        if self.committed(transaction):
            return False
        gone = lambda v: F.lit(v).alias("_gone")
        rows = [] if upserts is None else [upserts.select(*self.columns, gone(False))]
        if deletes is not None:
            rows.append(deletes.select(*[F.col(c) if c in self.key else F.lit(None).cast(self.kinds[c]).alias(c) for c in self.columns], gone(True)))
        folder, touched = self._write(reduce(DataFrame.unionByName, rows))
        self._publish({k: [*self.folders.get(k, []), *([folder] if k in touched else [])] for k in {*self.folders, *touched}}, self.done | ({transaction[0]: transaction[1]} if transaction else {}))
        return True

    def replace(self, rows: DataFrame) -> None:
        """Rows that say the same as those of their keys in another form; they do not count as a change of content."""
        folder, touched = self._write(rows.withColumn("_gone", F.lit(False)))
        self._publish({k: [*self.folders.get(k, []), *([folder] if k in touched else [])] for k in {*self.folders, *touched}}, self.done, 0)

    def put(self, rows: DataFrame) -> None:
        """The rows in place of all that were there."""
        folder, touched = self._write(rows.withColumn("_gone", F.lit(False)))
        self._publish({k: [folder] for k in touched}, self.done)

    def compact(self, folders: int = 2) -> list[int]:
        """Rewrite the parts that are made up of so many folders or more, and no others; gives those parts."""
        many = sorted(k for k, v in self.folders.items() if len(v) >= folders)
        if many:
            folder, touched = self._write(self.read(parts=many).withColumn("_gone", F.lit(False)))
            self._publish({k: v if k not in many else [folder] if k in touched else [] for k, v in self.folders.items()}, self.done, 0)
        return many

    def vacuum(self, keep: int = 1) -> None:
        """Delete folders and manifests that none of the newest keep versions needs. Readers of older ones lose them."""
        wanted: set[str] = set()
        for v in range(max(1, self.version - keep + 1), self.version + 1):
            older = Table(self.spark, self.path, self.schema, self.key, self.parts, self.by, self.merge) if v != self.version else self
            if older is not self:
                older._open(v)
            wanted |= {f for held in older.folders.values() for f in held}
        data = Folder(self.spark, f"{self.path}/data")
        for name in data.names():
            if name.removeprefix("_commit=") not in wanted:
                data.delete(name)
        for name in self.manifests.names():
            if name.startswith("v") and int(name[1:-5]) <= self.version - keep:
                self.manifests.delete(name)
