"""A cache of finished texts as a table that streams write to: rows merged by key, each micro-batch once, readers never between two states.

The table is a folder with a directory for each state of each bucket of keys, and small files `current-N` that name the
directories which make up state N and the last batch that went in. A merge rewrites only the buckets that the batch touches,
aside, and puts the next `current` file in place last: before that readers see the old state, after it the new one. A batch
that is replayed finds its number there and changes nothing; directories of a merge that was killed are named by nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS = 64


class Cache:
    """Keyed rows in a folder that driver and executors share. order: columns whose greatest values win among rows of a key."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "key", order: tuple[str, ...] = ("cached_at_ms",), buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.key, self.order, self.buckets = spark, path.rstrip("/"), schema, key, order, buckets

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def state(self) -> dict:
        """{version, batch, parts: {bucket: directory}} as readers see it."""
        store, root = self._file("")
        if not store.exists(root):
            return {"version": 0, "batch": {}, "parts": {}}
        numbers = [int(s.getPath().getName().removeprefix("current-")) for s in store.listStatus(root) if s.getPath().getName().startswith("current-")]
        if not numbers:
            return {"version": 0, "batch": {}, "parts": {}}
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.path}/current-{max(numbers)}").collect()))

    def read(self) -> DataFrame:
        parts = list(self.state()["parts"].values())
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p}" for p in parts]) if parts else self.spark.createDataFrame([], self.schema)

    def _publish(self, state: dict) -> None:
        """The one step that readers notice: fails if another writer has put the same version there first."""
        store, made = self._file(f"aside-{uuid.uuid4().hex}")
        out = store.create(made, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        _, there = self._file(f"current-{state['version']}")
        if store.exists(there) or not store.rename(made, there):
            raise RuntimeError(f"another writer has made version {state['version']}")

    def _rewrite(self, touched: DataFrame, make: Callable[[DataFrame], DataFrame], batch: tuple[str, int] | None) -> bool:
        """The next state: buckets in `touched` (bucket) hold make(their old rows)."""
        old = self.state()
        if batch and old["batch"].get(batch[0], -1) >= batch[1]:
            return False
        names = [r[0] for r in touched.distinct().collect()]  # at most `buckets`
        there = [f"{self.path}/{old['parts'][str(b)]}" for b in names if str(b) in old["parts"]]
        rows = self.spark.read.schema(self.schema).parquet(*there) if there else self.spark.createDataFrame([], self.schema)
        run = f"state-{old['version'] + 1}-{uuid.uuid4().hex}"
        made = make(rows).withColumn("bucket", self.bucket())
        made.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{run}")
        store, _ = self._file("")
        parts = {k: v for k, v in old["parts"].items() if int(k) not in names}
        for b in names:
            if store.exists(self._file(f"{run}/bucket={b}")[1]):
                parts[str(b)] = f"{run}/bucket={b}"
        self._publish({"version": old["version"] + 1, "batch": old["batch"] | ({batch[0]: batch[1]} if batch else {}), "parts": parts})
        return True

    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def merge(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Puts rows in; of a key the last by `order` stays. batch: (writer, number); one that went in before is left out. False if so."""
        columns = self.spark.createDataFrame([], self.schema).columns
        rows = rows.select(*columns).where(F.col(self.key).isNotNull())
        last = Window.partitionBy(self.key).orderBy(*[F.desc(c) for c in self.order], F.desc("__new"))

        def make(old: DataFrame) -> DataFrame:
            both = old.withColumn("__new", F.lit(0)).union(rows.withColumn("__new", F.lit(1)))
            return both.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "__new")

        return self._rewrite(rows.select(self.bucket().alias("bucket")), make, batch)

    def sweep(self, now_ms: int, age_ms: int, at: str = "cached_at_ms") -> bool:
        """Rows of that age or older go."""
        stale = self.read().where(F.col(at) <= now_ms - age_ms)
        return self._rewrite(stale.select(self.bucket().alias("bucket")), lambda old: old.where(F.col(at) > now_ms - age_ms), None)

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all that none of the last `keep` states names; readers of older ones must have ended."""
        store, root = self._file("")
        names = [s.getPath().getName() for s in store.listStatus(root)]
        numbers = sorted(int(n.removeprefix("current-")) for n in names if n.startswith("current-"))
        held = set()
        for n in numbers[-keep:]:
            state = json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.path}/current-{n}").collect()))
            held |= {p.split("/")[0] for p in state["parts"].values()} | {f"current-{n}"}
        for name in names:
            if name not in held:
                store.delete(self._file(name)[1], True)

    def sink(self, writer: str) -> Callable[[DataFrame, int], None]:
        """For writeStream.foreachBatch: merges each micro-batch, once."""
        return lambda rows, number: (self.merge(rows.persist(), (writer, number)), rows.unpersist()) and None
