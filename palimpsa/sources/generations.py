"""A keyed table store in generations: load, validate, switch.

A generation is a list of files by table and bucket. Files are written by a data
source of two phases: a task writes files of a name that no other attempt has, and
reports them; only when all tasks have is the generation's manifest put in place, so
what killed or repeated tasks left behind is never read. Readers follow a pointer,
which moves by one rename and only to a generation that was validated.

Changes make a new generation by copy on write: buckets without a change keep their
files. A generation is validated by multiset digests of each bucket: the number of rows
and the sum of their hashes, of what is stored against what is expected.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..shipping import importable

BUCKET = "_bucket"
POINTERS = "pointers"
#: Rows of a row group; batches that arrive are smaller.
GROUP = 1 << 17


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[int, str, int]]  # bucket, file, rows


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.folder, self.manifest = options["path"], options["manifest"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Rows come in order of their bucket; each has one file of this attempt."""
        fs, folder = _fs(self.folder)
        fs.create_dir(folder, recursive=True)
        files, at, out, held = [], None, None, []

        def flush() -> None:
            if held:
                out.write_table(pa.Table.from_batches(held), row_group_size=GROUP)
                held.clear()

        for batch in iterator:
            buckets = batch.column(batch.schema.get_field_index(BUCKET)).to_numpy(zero_copy_only=False)
            rows = batch.drop_columns([BUCKET])
            low = 0
            while low < len(buckets):
                bucket = int(buckets[low])
                high = int(buckets.searchsorted(bucket, side="right"))
                if bucket != at:
                    if out is not None:
                        flush()
                        out.close()
                    at, name = bucket, f"{bucket:05d}-{uuid.uuid4().hex}.parquet"
                    out = pq.ParquetWriter(f"{folder}/{name}", rows.schema, filesystem=fs)
                    files.append([bucket, name, 0])
                held.append(rows.slice(low, high - low))
                files[-1][2] += high - low
                low = high
                if sum(map(len, held)) >= GROUP:
                    flush()
        if out is not None:
            flush()
            out.close()
        return Written([tuple(f) for f in files])

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = _fs(self.manifest)
        found = sorted(f for m in messages if m is not None for f in m.files)
        with fs.open_output_stream(f"{path}.new") as f:
            f.write(json.dumps(found).encode())
        fs.move(f"{path}.new", path)

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = _fs(self.folder)
        for _, name, _ in (f for m in messages if m is not None for f in m.files):
            fs.delete_file(f"{folder}/{name}")


class GenerationFiles(DataSource):
    """Writes rows that are dealt and sorted by BUCKET; options: path (folder), manifest (file)."""

    @classmethod
    def name(cls) -> str:
        return "palimpsa_generation"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options)


class Invalid(ValueError):
    """A generation differs from what is expected."""


class Generations:
    """Tables below ``root`` (a path that all executors share); ``keys`` names each table's key columns."""

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, list[str]], buckets: int = 64, tasks: int | None = None) -> None:
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets
        self.tasks = tasks or buckets
        importable(spark)
        spark.dataSource.register(GenerationFiles)
        self.fs, self.path = _fs(self.root)
        self.fs.create_dir(f"{self.path}/manifests", recursive=True)

    def _json(self, name: str) -> object:
        if self.fs.get_file_info(f"{self.path}/{name}").type == pafs.FileType.NotFound:
            return None
        with self.fs.open_input_stream(f"{self.path}/{name}") as f:
            return json.loads(f.read())

    def _put(self, name: str, value: object) -> None:
        """A new file, in place by one rename."""
        made = f"{self.path}/{name}.{uuid.uuid4().hex}"
        self.fs.create_dir(made.rpartition("/")[0], recursive=True)
        with self.fs.open_output_stream(made) as f:
            f.write(json.dumps(value).encode())
        if self.fs.get_file_info(f"{self.path}/{name}").type != pafs.FileType.NotFound:
            raise FileExistsError(name)
        self.fs.move(made, f"{self.path}/{name}")

    def _pointers(self) -> list[str]:
        files = self.fs.get_file_info(pafs.FileSelector(f"{self.path}/{POINTERS}", allow_not_found=True))
        return sorted(f.base_name for f in files if f.base_name.isdigit())

    def current(self) -> str | None:
        """The generation that readers see."""
        every = self._pointers()
        return self._json(f"{POINTERS}/{every[-1]}")["generation"] if every else None

    def manifest(self, generation: str) -> dict:
        found = self._json(f"manifests/{generation}")
        if found is None:
            raise KeyError(generation)
        return found

    def read(self, table: str, generation: str | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table of a generation, of the current one by default."""
        own = self.manifest(generation or self.current())["tables"][table]
        schema = StructType.fromJson(own["schema"])
        files = [f"{self.root}/{table}/{name}" for bucket, name, _ in own["files"] if buckets is None or bucket in set(buckets)]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def bucket(self, table: str) -> Column:
        return F.pmod(F.xxhash64(*self.keys[table]), F.lit(self.buckets)).cast("int")

    def _dealt(self, rows: DataFrame, table: str) -> DataFrame:
        """Rows with their BUCKET, dealt by it: one bucket a task, if there are as many tasks."""
        rows = rows.withColumn(BUCKET, self.bucket(table))
        return rows.repartition(self.tasks, BUCKET) if self.tasks < self.buckets else rows.repartitionById(self.tasks, BUCKET)

    def _write(self, dealt: DataFrame, table: str, generation: str) -> list:
        parts = f"{self.root}/manifests/{generation}-{table}.parts"
        if self.tasks < self.buckets:
            dealt = dealt.sortWithinPartitions(BUCKET)
        dealt.write.format(GenerationFiles.name()).option("path", f"{self.root}/{table}").option("manifest", parts).mode("append").save()
        return self._json(f"manifests/{generation}-{table}.parts")

    def load(self, tables: dict[str, DataFrame]) -> str:
        """A generation of whole tables; nobody reads it yet."""
        generation = uuid.uuid4().hex
        made = {name: {"schema": json.loads(rows.schema.json()), "files": self._write(self._dealt(rows, name), name, generation)} for name, rows in tables.items()}
        self._put(f"manifests/{generation}", {"parent": None, "tables": made})
        return generation

    def apply(self, changes: dict[str, DataFrame], deleted: str, seq: str, base: str | None = None) -> str:
        """A generation that follows ``base``: of each key the last change by ``seq`` holds, and a deletion removes it.

        ``changes`` have the table's columns, ``deleted`` and ``seq``. Only buckets with
        a change are written again.
        """
        base = base or self.current()
        before, generation = self.manifest(base), uuid.uuid4().hex
        tables = dict(before["tables"])
        for name, rows in changes.items():
            keys = self.keys[name]
            columns = StructType.fromJson(tables[name]["schema"]).names
            last = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns, deleted), seq).alias("r")).select("r.*")
            # As many numbers as there are buckets at most.
            touched = sorted(r[0] for r in rows.select(self.bucket(name)).distinct().collect())
            kept = [f for f in tables[name]["files"] if f[0] not in set(touched)]
            merged = self._merged(self.read(name, base, touched).select(*columns), last, name, deleted)
            tables[name] = tables[name] | {"files": sorted(kept + self._write(merged, name, generation))}
        self._put(f"manifests/{generation}", {"parent": base, "tables": tables})
        return generation

    def _merged(self, old: DataFrame, last: DataFrame, table: str, deleted: str) -> DataFrame:
        """Old rows and the last changes of their keys meet where they are written, in one dealing."""
        keys = self.keys[table]
        both = old.withColumn("_gone", F.lit(None).cast("boolean")).unionByName(last.withColumn("_gone", F.coalesce(F.col(deleted), F.lit(False))).drop(deleted))
        changed = F.count("_gone").over(W.partitionBy(BUCKET, *keys)) > 0
        for k in keys:
            changed = changed & F.col(k).isNotNull()  # as in a join, a missing key is no key of another row
        rows = self._dealt(both, table).withColumn("_changed", changed)
        return rows.filter(F.when(F.col("_gone").isNull(), ~F.col("_changed")).otherwise(~F.col("_gone"))).drop("_gone", "_changed")

    def digests(self, table: str, rows: DataFrame) -> DataFrame:
        """``bucket, n, total``: a multiset digest of the rows of each bucket."""
        columns = sorted(rows.columns)
        h, low = F.col("h"), F.lit((1 << 32) - 1)
        own = rows.select(self.bucket(table).alias("bucket"), F.xxhash64(*columns).alias("h")).groupBy("bucket")
        # Halves are summed as whole numbers, which 2^31 rows of a bucket can not exceed.
        sums = own.agg(F.count(F.lit(1)).alias("n"), F.sum(F.shiftright(h, 32)).alias("high"), F.sum(h.bitwiseAND(low)).alias("low"))
        return sums.select("bucket", "n", (F.col("high").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("low")).cast("decimal(38,0)").alias("total"))

    def differences(self, generation: str, expected: dict[str, DataFrame]) -> DataFrame:
        """``table, bucket`` where a generation is not what is expected."""
        out = self.spark.createDataFrame([], "table string, bucket int")
        for name, rows in expected.items():
            have = self.read(name, generation)
            a = self.digests(name, have).select("bucket", F.struct("n", "total").alias("a"))
            b = self.digests(name, rows.select(*have.columns)).select("bucket", F.struct("n", "total").alias("b"))
            out = out.union(a.join(b, "bucket", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select(F.lit(name), "bucket"))
        return out

    def validate(self, generation: str, expected: dict[str, DataFrame], references: dict[tuple[str, str], tuple[str, str]] | None = None) -> None:
        """Raises Invalid unless every bucket is as expected and every reference, ``(table, column)`` to ``(table, key)``, is met."""
        wrong = self.differences(generation, expected).limit(20).collect()
        if wrong:
            raise Invalid(f"buckets differ: {[tuple(r) for r in wrong]}")
        for (table, column), (to, key) in (references or {}).items():
            have = self.read(table, generation).select(F.col(column).alias("x")).filter("x is not null").distinct()
            if not have.join(self.read(to, generation).select(F.col(key).alias("x")), "x", "left_anti").isEmpty():
                raise Invalid(f"{table}.{column} names rows that {to} does not have")
        if self._json(f"validated/{generation}") is None:
            self._put(f"validated/{generation}", {"tables": sorted(expected)})

    def switch(self, generation: str, instead_of: str | None = None) -> None:
        """Readers see the generation from now on. ``instead_of``: refuse if another one is current."""
        if self._json(f"validated/{generation}") is None:
            raise Invalid("a generation is validated before it is read")
        every = self._pointers()
        if instead_of is not None and self.current() != instead_of:
            raise Invalid("another generation has become current")
        self._put(f"{POINTERS}/{int(every[-1]) + 1 if every else 0:012d}", {"generation": generation})

    def roll_back(self) -> None:
        """Back to the generation that was current before."""
        every = self._pointers()
        if len(every) < 2:
            raise Invalid("there is no earlier generation")
        self.switch(self._json(f"{POINTERS}/{every[-2]}")["generation"])

    def clean(self, keep: int = 2) -> int:
        """Removes files that none of the last ``keep`` current generations has; the number of files."""
        live = {self._json(f"{POINTERS}/{p}")["generation"] for p in self._pointers()[-keep:]}
        used = {(t, f[1]) for g in live for t, own in self.manifest(g)["tables"].items() for f in own["files"]}
        gone = 0
        for table in self.keys:
            for f in self.fs.get_file_info(pafs.FileSelector(f"{self.path}/{table}", allow_not_found=True)):
                if f.is_file and (table, f.base_name) not in used:
                    self.fs.delete_file(f.path)
                    gone += 1
        return gone
