"""State of a loop kept on disk in buckets of its key, so that a step shuffles messages only.

A ``Store`` writes tables bucketed (and sorted) by their key below the shared checkpoint
folder, all in one number of buckets. What is shuffled by the key to that number meets them without
another exchange. Steps are committed to a manifest, one small file per step put in place by a
rename, from which a loop can be taken up again; the store deletes what no later step reads.

A ``State`` is the newest value per key: a few runs of changed rows. When there is one too many, the newest are merged bucket by bucket, and with
them every older one that is not more than twice their size, so a row is rewritten a logarithmic number of times however many steps there are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import checkpoint_root


MOST_RUNS, FEWEST_MERGED = 6, 4
COALESCE = "spark.sql.adaptive.coalescePartitions.enabled"


class Store:
    """Bucketed tables of one loop. ``path`` opens the folder of an earlier run."""

    def __init__(self, spark: SparkSession, label: str, path: str | None = None):
        self.spark = spark
        self.path = path or f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
        last = self.last() if path else None
        self.buckets = last["buckets"] if last else int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        self._tables: dict[str, str] = {}

    @contextmanager
    def loop(self) -> Iterator[None]:
        """Around a loop: each bucket is written by a task of its own (merging small partitions would only make
        one task write all buckets one by one), and in the end the tables leave the catalog."""
        before = self.spark.conf.get(COALESCE, None)
        self.spark.conf.set(COALESCE, "false")
        try:
            yield
        finally:
            if before is None:
                self.spark.conf.unset(COALESCE)
            else:
                self.spark.conf.set(COALESCE, before)
            self.close()

    def save(self, df: DataFrame, name: str, keys: list[str], deal: bool = False) -> DataFrame:
        """Write the rows as a bucketed table, and read it. ``deal`` shuffles them by the key first, which
        rows that come from a grouping or join on the key do not need."""
        if deal:
            df = df.repartition(self.buckets, *keys)
        table = self._tables[name] = f"topicweft_{uuid.uuid4().hex}"
        writer = df.write.bucketBy(self.buckets, *keys).sortBy(*keys)
        writer.option("path", f"{self.path}/{name}").mode("overwrite").saveAsTable(table)
        return self.spark.table(table)

    def read(self, name: str, schema: str, keys: list[str]) -> DataFrame:
        """A table of this folder, also one that an earlier run has written."""
        if name not in self._tables:
            table = self._tables[name] = f"topicweft_{uuid.uuid4().hex}"
            by = ", ".join(f"`{k}`" for k in keys)
            self.spark.sql(
                f"CREATE TABLE {table} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS "
                f"LOCATION '{self.path}/{name}'"
            )
        return self.spark.table(self._tables[name])

    def drop(self, name: str) -> None:
        """Delete a table that no later step and no result reads."""
        if name in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop(name)}")
        files, where = self.files(f"{self.path}/{name}".rstrip("/"))
        files.delete(where, True)

    def close(self) -> None:
        """Take the tables out of the catalog; the files stay. Frames that were read before stay readable."""
        for table in self._tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._tables.clear()

    def commit(self, step: int, entry: dict) -> None:
        """Record a finished step: written aside, then renamed, so that it is there whole or not at all."""
        context = self.spark.sparkContext
        files, aside = self.files(f"{self.path}/manifest/.step={step}")
        out = files.create(aside, True)
        out.write(bytearray(json.dumps(entry | {"step": step, "buckets": self.buckets}).encode()))
        out.close()
        target = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/step={step}")
        files.delete(target, False)
        files.rename(aside, target)

    def last(self) -> dict | None:
        """The newest committed step."""
        files, folder = self.files(f"{self.path}/manifest")
        if not files.exists(folder):
            return None
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        found = [int(n.split("=")[1]) for n in names if n.startswith("step=")]
        if not found:
            return None
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/step={max(found)}")
        stream = files.open(path)
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def files(self, path: str):
        """The file system of a path and the path."""
        context = self.spark.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(context._jsc.hadoopConfiguration()), where


class State:
    """The newest values of ``columns`` per key, as runs of changed rows in a store; of columns in ``sums``, the sum over the runs."""

    def __init__(self, store: Store, keys: list[str], types: dict[str, str], sums: tuple[str, ...] = ()):
        self.sums = sums
        self.store, self.keys, self.columns = store, keys, [c for c in types if c not in keys]
        self.types = types
        self.schema = ", ".join(f"`{c}` {types[c]}" for c in [*keys, *self.columns])
        self.runs: list[tuple[str, int]] = []  # name and rows, oldest first

    def push(self, name: str, rows: int) -> list[str]:
        """Add a saved table (keys and columns) as the newest run. Returns runs that were merged and are no longer read."""
        self.runs.append((name, rows))
        if len(self.runs) <= MOST_RUNS:
            return []
        first, total = len(self.runs) - 1, rows
        while first and (len(self.runs) - first < FEWEST_MERGED or self.runs[first - 1][1] <= 2 * total):
            first -= 1
            total += self.runs[first][1]
        merged = [n for n, _ in self.runs[first:]]
        name = f"merged-{uuid.uuid4().hex}"
        self.store.save(self._together(merged), name, self.keys)
        self.runs[first:] = [(name, total)]
        return merged

    def _together(self, names: list[str]) -> DataFrame:
        out = self._run(names[0])
        for name in names[1:]:
            both = self._marked(out, "_old").join(self._marked(self._run(name), "_new"), self.keys, "full")
            out = both.select(*self.keys, F.coalesce("_new", "_old").alias("_s"), *[self._sum(c) for c in self.sums])
            out = out.select(*self.keys, *[F.col(f"_sum_{c}" if c in self.sums else f"_s.{c}").alias(c) for c in self.columns])
        return out

    def _sum(self, column: str) -> Column:
        nothing = F.lit(0).cast(self.types[column])
        return (F.coalesce(f"_old.{column}", nothing) + F.coalesce(f"_new.{column}", nothing)).alias(f"_sum_{column}")

    def _run(self, name: str) -> DataFrame:
        return self.store.read(name, self.schema, self.keys)

    def _marked(self, run: DataFrame, mark: str) -> DataFrame:
        return run.select(*self.keys, F.struct(*self.columns).alias(mark))

    def look(self, df: DataFrame) -> DataFrame:
        """``df`` with the columns of the state (null for keys that have none)."""
        marks = [f"_run{i}" for i in range(len(self.runs))]
        for mark, (name, _) in zip(marks, self.runs):
            df = df.join(self._marked(self._run(name), mark), self.keys, "left")
        value = F.coalesce(*[F.col(m) for m in reversed(marks)])
        return df.withColumn("_s", value).drop(*marks).select("*", "_s.*").drop("_s")

    def table(self) -> DataFrame:
        """All keys and their values."""
        return self._together([name for name, _ in self.runs])
