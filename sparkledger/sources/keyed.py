"""Tables in hash buckets of a key, whose commits can be repeated.

A commit writes its rows into a folder of its own and then one manifest: the layout, and for every bucket the folders that are live. Readers
follow the newest manifest, so a half-written commit is never seen, rows of another layout never mix in, and a commit with the label of
the newest one takes its place instead of adding to it. Only buckets that the new rows fall into are read and written.

One writer at a time; a manifest has one row for each live folder, at most buckets times ``most_parts``.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as St

MANIFEST = "commit bigint, label string, buckets int, row_schema string, bucket int, part bigint"
#: Manifests that stay readable, the newest ones; what only older ones name may be removed.
KEPT = 4

Merge = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class State:
    """What one manifest says; ``live`` has the commits that hold each bucket's rows."""

    commit: int
    label: str
    buckets: int
    schema: St.StructType
    live: dict[int, tuple[int, ...]]


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All old rows of the keys that come again give way to the new rows."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64, most_parts: int = 16, form: str = "parquet"):
        self.spark, self.path, self.keys, self.buckets, self.most_parts, self.form = spark, path.rstrip("/"), keys, buckets, most_parts, form

    # --- manifests --------------------------------------------------------------------------

    def _folder(self, name: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def commits(self) -> list[int]:
        """Numbers of the finished commits; a manifest counts once Spark has marked it as whole."""
        files, folder = self._folder("manifests")
        if not files.exists(folder):
            return []
        marks = files.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/*/_SUCCESS")) or []
        return sorted(int(m.getPath().getParent().getName()) for m in marks)

    def state(self, but: str | None = None) -> State | None:
        """The newest manifest; with ``but``, the one before it where the newest has that label."""
        for commit in reversed(self.commits()):
            rows = self.spark.read.schema(MANIFEST).json(f"{self.path}/manifests/{commit}").collect()  # a row for each live folder
            if but is not None and rows[0].label == but:
                continue
            live: dict[int, tuple[int, ...]] = {}
            for row in sorted((r for r in rows if r.bucket is not None), key=lambda r: (r.bucket, r.part)):
                live[row.bucket] = (*live.get(row.bucket, ()), row.part)
            return State(rows[0].commit, rows[0].label, rows[0].buckets, St.StructType.fromJson(json.loads(rows[0].row_schema)), live)
        return None

    def _publish(self, state: State) -> None:
        head = (state.commit, state.label, state.buckets, state.schema.json())
        rows = [(*head, bucket, part) for bucket, parts in state.live.items() for part in parts] or [(*head, None, None)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.path}/manifests/{state.commit}")

    # --- rows -------------------------------------------------------------------------------

    def bucket_of(self, buckets: int):
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")

    def _rows(self, state: State, buckets: list[int] | None = None) -> DataFrame:
        """The live rows, or those of some buckets; other folders are not even listed."""
        wanted = state.live if buckets is None else {b: state.live[b] for b in buckets if b in state.live}
        paths = [f"{self.path}/data/commit={part}/bucket={bucket}" for bucket, parts in wanted.items() for part in parts]
        if not paths:
            return self.spark.createDataFrame([], state.schema)
        reader = self.spark.read.schema(state.schema).format(self.form)
        return reader.load(paths)

    def read(self, but: str | None = None) -> DataFrame | None:
        """All rows, null while there is no commit; ``but`` leaves the newest commit out if it has this label."""
        state = self.state(but)
        return None if state is None else self._rows(state)

    def read_commit(self) -> DataFrame | None:
        """The rows that the newest commit wrote: with :meth:`add`, those that came with it and those of buckets it made one again."""
        state = self.state()
        if state is None:
            return None
        own = State(state.commit, state.label, state.buckets, state.schema, {b: (state.commit,) for b, parts in state.live.items() if state.commit in parts})
        return self._rows(own)

    def touched(self, keys: DataFrame, state: State) -> list[int]:
        """The buckets that some keys fall into: as many numbers as there are buckets at most."""
        return sorted(r[0] for r in keys.select(self.bucket_of(state.buckets).alias("b")).distinct().collect())

    def read_for(self, keys: DataFrame, but: str | None = None) -> DataFrame | None:
        """The rows of the buckets that ``keys``, a table with the key columns, fall into."""
        state = self.state(but)
        return None if state is None else self._rows(state, self.touched(keys, state))

    # --- commits ----------------------------------------------------------------------------

    def commit(self, rows: DataFrame, merge: Merge | None = None, label: str = "", replaced: DataFrame | None = None) -> int:
        """Merges ``rows`` into their buckets and gives the commit's number.

        Without ``merge`` the rows of a key replace all of its old ones. ``replaced`` names further keys whose buckets are rewritten, such as
        those whose rows all go. A table of another number of buckets is laid out anew. ``rows`` is computed twice, so it has to be repeatable.
        """
        old = self.state(label or None)
        number = max([*self.commits(), 0]) + 1
        if old is None:
            return self._write(rows, number, label, rows.schema, {}, None)
        combine = merge or (lambda a, b: replace_by_key(a, b, self.keys))
        if old.buckets != self.buckets:
            out = combine(self._rows(old), rows)
            return self._write(out, number, label, out.schema, {}, None)
        keys = rows.select(*self.keys) if replaced is None else rows.select(*self.keys).union(replaced.select(*self.keys))
        buckets = self.touched(keys, old)
        out = combine(self._rows(old, buckets), rows)
        return self._write(out, number, label, out.schema, old.live, buckets)

    def add(self, rows: DataFrame, label: str = "") -> int:
        """Adds rows and rewrites nothing, but for buckets of over ``most_parts`` folders, which become one again."""
        old = self.state(label or None)
        if old is None or old.buckets != self.buckets:
            return self.commit(rows, lambda a, b: a.unionByName(b, allowMissingColumns=True), label)
        number = max([*self.commits(), 0]) + 1
        full = [b for b, parts in old.live.items() if len(parts) >= self.most_parts]
        out = rows if not full else self._rows(old, full).unionByName(rows, allowMissingColumns=True)
        schema = self.spark.createDataFrame([], old.schema).unionByName(self.spark.createDataFrame([], rows.schema), allowMissingColumns=True).schema
        return self._write(out, number, label, schema, old.live, full, keep=True)

    def _write(self, out: DataFrame, number: int, label: str, schema: St.StructType, live: dict, gone: list[int] | None, keep: bool = False) -> int:
        """Writes a commit's folder and its manifest. ``gone`` are buckets whose older folders end; with ``keep`` the others go on beside the new ones."""
        # Cut by bucket; a bucket that holds a third of all rows is written by several tasks.
        placed = out.withColumn("bucket", self.bucket_of(self.buckets)).hint("rebalance", "bucket")
        target = f"{self.path}/data/commit={number}"
        placed.write.mode("overwrite").partitionBy("bucket").format(self.form).save(target)
        files, folder = self._folder(f"data/commit={number}")
        names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        new = {int(n.split("=")[1]) for n in names if n.startswith("bucket=")}
        kept = {b: parts for b, parts in live.items() if gone is not None and b not in gone}
        state = {b: (*(kept.get(b, ()) if keep or b not in new else ()), *((number,) if b in new else ())) for b in {*kept, *new}}
        self._publish(State(number, label, self.buckets, schema, state))
        return number

    def clean(self, kept: int = KEPT) -> None:
        """Removes what none of the newest ``kept`` manifests names."""
        numbers = self.commits()
        for number in numbers[:-kept]:
            files, folder = self._folder(f"manifests/{number}")
            files.delete(folder, True)
        named = set()
        for number in numbers[-kept:]:
            rows = self.spark.read.schema(MANIFEST).json(f"{self.path}/manifests/{number}").collect()
            named |= {(r.part, r.bucket) for r in rows} | {(number, None)}
        for status in self._children("data"):
            part = int(status.getPath().getName().split("=")[1])
            for inner in self._children(f"data/commit={part}"):
                name = inner.getPath().getName()
                if name.startswith("bucket=") and (part, int(name.split("=")[1])) not in named and part <= numbers[-1]:
                    self._folder(f"data/commit={part}/{name}")[0].delete(inner.getPath(), True)

    def _children(self, name: str):
        files, folder = self._folder(name)
        return list(files.listStatus(folder)) if files.exists(folder) else []
