"""Tables of sessions in hashed buckets: sessions are overwritten all at once or not at all.

A session's rows are in one bucket, by a hash of its id, and a bucket is a folder of a version, so the number of files
follows the buckets and the bytes, not the sessions. A manifest says which version each bucket has. An
overwrite writes the buckets that it touches as a new version, which nobody reads yet, by Spark's
committer; then the next manifest, which must not exist yet, takes its place by a rename. What is killed before
that leaves the old manifest and so the old sessions. Writers that touch different buckets
both succeed; of two that touch the same one the second is refused and may try again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a new table.
BUCKETS = 256


class Conflict(RuntimeError):
    """Another writer has changed the same buckets meanwhile."""


def bucket(session_id, buckets: int):
    return F.pmod(F.xxhash64(session_id), F.lit(buckets)).cast("int")


class SessionTable:
    """A table with a column ``session_id`` below ``path``, on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self._new_buckets = spark, path.rstrip("/"), buckets
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _listed(self, name: str) -> list[str]:
        folder = self._at(name)
        return [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []

    def manifests(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._listed("manifest") if n.endswith(".json") and not n.startswith((".", "_")))

    def manifest(self, number: int | None = None) -> dict:
        """``number, buckets, schema, at``: the newest one, or that of a number; ``at`` has each bucket's version."""
        if number is None:
            numbers = self.manifests()
            if not numbers:
                return {"number": 0, "buckets": self._new_buckets, "schema": None, "at": {}}
            number = numbers[-1]
        text = self.spark.read.text(f"{self.path}/manifest/{number}.json", wholetext=True).first()[0]
        return json.loads(text)

    def read(self, sessions: Iterable[str] | None = None, number: int | None = None) -> DataFrame:
        """The table as the newest manifest, or one of a number, has it; of some sessions only their buckets are read."""
        now = self.manifest(number)
        if now["schema"] is None:
            raise FileNotFoundError(f"no table at {self.path}")
        at = now["at"]
        if sessions is None:
            return self._read(now, at)
        wanted = self.spark.createDataFrame([(s,) for s in sessions], "session_id string")
        hit = {str(r[0]) for r in wanted.select(bucket("session_id", now["buckets"])).distinct().collect()}
        rows = self._read(now, {b: v for b, v in at.items() if b in hit})
        return rows.join(F.broadcast(wanted), rows["session_id"].cast("string") == wanted["session_id"], "left_semi")

    def _read(self, now: dict, at: dict[str, str]) -> DataFrame:
        """``at`` has no more entries than there are buckets."""
        schema = self.spark.createDataFrame([], now["schema"]).schema
        if not at:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/data/{v}/bucket={b}" for b, v in sorted(at.items())))

    def overwrite(self, rows: DataFrame, gone: DataFrame | None = None) -> int:
        """The sessions of ``rows`` have these rows only, those of ``gone`` none; others stay. Returns the manifest's number.

        A bucket that is touched is written anew whole. Large buckets are split over several tasks and files.
        """
        base = self.manifest()
        if base["schema"] is None:
            base["schema"] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        own = bucket(F.col("session_id").cast("string"), base["buckets"]).alias("bucket")
        changed = rows.select("session_id")
        if gone is not None:
            changed = changed.unionByName(gone.select("session_id"))
        touched = {str(r[0]) for r in changed.select(own).distinct().collect()}
        if not touched:
            return base["number"]
        old = self._read(base, {b: v for b, v in base["at"].items() if b in touched})
        left = old.join(changed.distinct(), "session_id", "left_anti")
        new = left.select(*old.columns).unionByName(rows.select(*old.columns))
        version = f"{base['number'] + 1}-{uuid.uuid4().hex[:12]}"
        # Rows of a bucket come together; what is too large for one task is split, what is small joins others.
        dealt = new.withColumn("bucket", own).hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "session_id")
        dealt.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/data/{version}")
        there = {n.removeprefix("bucket=") for n in self._listed(f"data/{version}") if n.startswith("bucket=")}
        return self._commit(base, {b: version if b in there else None for b in touched})

    def _commit(self, base: dict, changed: dict[str, str | None]) -> int:
        """Make the next manifest; others' that touch other buckets are built upon."""
        while True:
            now = self.manifest()
            if now["schema"] is None:
                now["schema"], now["buckets"] = base["schema"], base["buckets"]
            if any(now["at"].get(b) != base["at"].get(b) for b in changed):
                raise Conflict(f"buckets of {self.path} were written meanwhile")
            at = {b: v for b, v in (now["at"] | changed).items() if v is not None}
            number = now["number"] + 1
            if self._published(number, json.dumps(now | {"number": number, "at": at})):
                return number

    def _published(self, number: int, text: str) -> bool:
        """Whether a manifest of that number could be put in place; False if there is one."""
        draft = self._at(f"manifest/.{number}-{uuid.uuid4().hex[:12]}")
        out = self._fs.create(draft, False)
        out.write(bytearray(text, "utf-8"))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        no_overwrite = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, self._at(f"manifest/{number}.json"), no_overwrite)
            return True
        except Exception as error:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                return False
            raise

    def vacuum(self, keep: int = 2) -> None:
        """Delete all but the newest ``keep`` manifests and the data that these don't name; no overwrite may be under way."""
        numbers = self.manifests()
        for n in numbers[:-keep]:
            self._fs.delete(self._at(f"manifest/{n}.json"), False)
        used: dict[str, set[str]] = {}
        for n in numbers[-keep:]:
            for b, v in self.manifest(n)["at"].items():
                used.setdefault(v, set()).add(f"bucket={b}")
        for version in self._listed("data"):
            if version not in used:
                self._fs.delete(self._at(f"data/{version}"), True)
                continue
            for name in set(self._listed(f"data/{version}")) - used[version]:
                if name.startswith("bucket="):
                    self._fs.delete(self._at(f"data/{version}/{name}"), True)
