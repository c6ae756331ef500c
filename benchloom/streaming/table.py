"""A table that a stream in update mode keeps: the newest row of each key, in few files however long the stream runs.

A micro-batch adds the rows it changed as a folder of its own. Every so often these are merged with the rows of windows
still open; windows that the watermark has closed cannot change any more and move to runs of closed rows, of which as many
as `every` of one level are joined into one of the next. So a row is rewritten as often as its window is open and then a
few times more, and reading ranks only what is open. What belongs to the table is told by a manifest that is written last: a
run that fails before leaves the old one, whose files are still there, and is repeated by the stream.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from benchloom.operators.records import latest_per_key


class UpsertTable:
    """Rows below `path` with unique `keys`; `closes` names the column after which a row is final, if the keys have it."""

    def __init__(self, spark: SparkSession, path: str, schema, keys: list[str], every: int = 16, closes: str = "window_end") -> None:
        if every < 2:
            raise ValueError("at least two folders are merged at a time")
        self.spark, self.path, self.keys, self.every, self.closes = spark, path, keys, every, closes
        self.schema, self.columns = schema, schema.fieldNames()

    def _files(self):
        context = self.spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(context._jsc.hadoopConfiguration()), context._jvm.org.apache.hadoop.fs.Path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._files()
        at = path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _remove(self, *folders: str) -> None:
        fs, path = self._files()
        for folder in folders:
            fs.delete(path(f"{self.path}/{folder}"), True)

    def manifest(self, before: int | None = None) -> dict:
        """The last manifest that was written to its end, or the last but those from number `before` on."""
        fs, path = self._files()
        numbers = sorted((int(n) for n in self._names("manifest") if n.isdigit() and (before is None or int(n) < before)), reverse=True)
        for n in numbers:
            if fs.exists(path(f"{self.path}/manifest/{n}/_SUCCESS")):
                return json.loads(self.spark.read.text(f"{self.path}/manifest/{n}").first()[0])
        return {"last": -1, "open": None, "closed": []}

    def _rows(self, *folders: str) -> DataFrame:
        """Stored rows, with the number of their micro-batch as `batch`."""
        kept = self.schema.simpleString()[7:-1]
        if not folders:
            return self.spark.createDataFrame([], self.schema).withColumn("batch", F.lit(0).cast("long"))
        return self.spark.read.schema(f"{kept.replace(':', ' ')}, batch long").parquet(*[f"{self.path}/{f}" for f in folders])

    def _updates(self, after: int) -> list[str]:
        return [f"updates/{n}" for n in sorted(int(n) for n in self._names("updates") if n.isdigit()) if n > after]

    def add(self, rows: DataFrame, number: int, watermark: str | None = None) -> None:
        """Store the rows that micro-batch `number` changed, and merge if it is time to. The same number may come again."""
        rows.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{self.path}/updates/{number}")
        # A batch that comes again after its merge starts from the manifest before.
        known = self.manifest(before=number)
        updates = [f for f in self._updates(known["last"]) if int(f.split("/")[1]) <= number]
        if len(updates) >= self.every:
            self._merge(known, updates, number, watermark)

    def _merge(self, known: dict, updates: list[str], number: int, watermark: str | None) -> None:
        newest = latest_per_key(self._rows(*filter(None, [known["open"]]), *updates), self.keys, ["batch"]).persist()
        final = F.lit(False)
        if watermark and self.closes in self.columns:
            # Windows are stored without a zone, in UTC.
            final = F.coalesce(F.col(self.closes) <= F.lit(watermark).cast("timestamp").cast("timestamp_ntz"), F.lit(False))
        closed = [tuple(c) for c in known["closed"]]
        newest.where(~final).write.mode("overwrite").parquet(f"{self.path}/open/{number}")
        if not newest.where(final).isEmpty():
            newest.where(final).write.mode("overwrite").parquet(f"{self.path}/closed/{number}-0")
            closed.append((f"closed/{number}-0", 0))
        newest.unpersist()
        level = 0
        while len(same := [c for c in closed if c[1] == level]) >= self.every:
            level += 1
            rows = self._rows(*[f for f, _ in same])
            # Rows of one window lie together; the session's advice on partition sizes decides how many files there are.
            rows.hint("rebalance").write.mode("overwrite").parquet(f"{self.path}/closed/{number}-{level}")
            closed = [c for c in closed if c not in same] + [(f"closed/{number}-{level}", level)]
        now = {"last": number, "open": f"open/{number}", "closed": closed}
        self._swap(now, number)
        # Whoever reads by the manifest before still finds its files.
        held = {f for m in (now, known) for f in [m["open"], *[c[0] for c in m["closed"]]]}
        older = [f"{kind}/{n}" for kind in ("open", "closed") for n in self._names(kind)]
        self._remove(*[f for f in older if f not in held], *[f"updates/{n}" for n in self._names("updates") if n.isdigit() and int(n) <= known["last"]])
        self._remove(*[f"manifest/{n}" for n in self._names("manifest") if n.isdigit() and int(n) < known["last"]])

    def _swap(self, manifest: dict, number: int) -> None:
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/{number}")

    def read(self) -> DataFrame:
        """The newest row of each key."""
        known = self.manifest()
        changing = self._rows(*filter(None, [known["open"]]), *self._updates(known["last"]))
        parts = [latest_per_key(changing, self.keys, ["batch"])]
        if known["closed"]:
            parts.append(self._rows(*[f for f, _ in known["closed"]]))
        return reduce(DataFrame.unionByName, parts).select(*self.columns)
