"""Tables that change by commits: batches, overlays, rollbacks and migrations, each published by one new file.

A store is a folder with ``data``, where each commit's rows stay as they were written, and ``log``, where the n-th commit's manifest
has the number n. A manifest names the folders that make up the table, and with which schema version each was
written. Writers write rows aside, check them as they lie on disk, and publish by creating the next number's file, which the file
system does for one writer only; so a crash before leaves rows that nobody
names, and no moment has neither the old version nor the new. Nothing is ever overwritten or deleted: rolling back is a commit that
names an earlier version's folders again.

A batch's key is the hash of its rows in any order. A batch whose key is in the present version is not imported again.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.staging import deleted


class Conflict(RuntimeError):
    """Another writer published this number first."""


class Violated(ValueError):
    """Checks that rows break, with how many do."""


@dataclass(frozen=True)
class Migration:
    """To schema ``version`` from the one before it: the new columns as SQL over the old ones, in order. ``keys`` are the key
    columns after it, and ``keys_before`` their names before, if they change."""

    version: int
    columns: dict[str, str]
    keys: list[str]
    keys_before: list[str] | None = None


@dataclass
class Manifest:
    number: int
    kind: str
    #: (folder, commit that wrote it, schema version it was written in, batch key)
    parts: list[tuple[str, int, int, str]]
    schema: int = 1
    counts: dict[str, int] = field(default_factory=dict)
    of: int | None = None


def content_key(df: DataFrame) -> tuple[str, int]:
    """A hash of the rows, the same in any order and partitioning, and their number. Columns count by name; repeats count."""
    row = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))), {"ignoreNullFields": "false"}), 256)
    word = lambda k: F.conv(F.substring(row, 8 * k + 1, 8), 16, 10).cast("decimal(38,0)")
    sums = df.agg(F.count("*").alias("n"), *(F.sum(word(k)).alias(f"h{k}") for k in range(8))).first()
    text = "|".join([*sorted(df.columns), *(str(v or 0) for v in sums)])
    return hashlib.sha256(text.encode()).hexdigest(), sums["n"]


class Store:
    """[V5, V10, V11] A table with a log. ``migrations`` are the steps between schema versions, from 2 on, which reading applies."""

    def __init__(self, spark: SparkSession, path: str, migrations: list[Migration] | None = None):
        self.spark, self.path, self.migrations = spark, path.rstrip("/"), {m.version: m for m in migrations or []}

    # ---- the log

    def _at(self, *parts: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        where, fs = self._at("log")
        if not fs.exists(where):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(where) if s.getPath().getName().endswith(".json"))

    def manifest(self, number: int | None = None) -> Manifest:
        """The present one, or that of a commit. Before any commit: number 0, without parts."""
        if number is None:
            number = max(self.numbers(), default=0)
        if number == 0:
            return Manifest(0, "empty", [])
        where, _ = self._at("log", f"{number:012}.json")
        text = self.spark.read.text(where.toString(), wholetext=True).first()[0]
        found = json.loads(text)
        found["parts"] = [tuple(p) for p in found["parts"]]
        return Manifest(**found)

    def _publish(self, made: Manifest) -> Manifest:
        where, fs = self._at("log", f"{made.number:012}.json")
        aside, _ = self._at("log", f".{made.number:012}.{uuid.uuid4().hex}")
        out = fs.create(aside, True)
        try:
            out.write(bytearray(json.dumps(made.__dict__).encode()))
        finally:
            out.close()
        # this rename fails where the name is taken: of two writers one wins, and no reader sees half a file
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(aside, where, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            fs.delete(aside, False)
            raise Conflict(f"commit {made.number} is taken") from e
        return made

    def _written(self, df: DataFrame, checks: dict[str, Column]) -> tuple[str, DataFrame]:
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        back = self.spark.read.schema(df.schema).parquet(f"{self.path}/{folder}")
        bad = back.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(k) for k, ok in checks.items())).first().asDict() if checks else {}
        if any(bad.values()):
            deleted(self.spark, f"{self.path}/{folder}")
            raise Violated(", ".join(f"{k}: {n}" for k, n in bad.items() if n))
        return folder, back

    # ---- commits

    def append(self, df: DataFrame, checks: dict[str, Column] | None = None, kind: str = "batch") -> Manifest:
        """The rows as one more commit; if the present version has a batch of the same rows, that version as it is. A row for which
        a check isn't true refuses all."""
        now = self.manifest()
        key, n = content_key(df)
        if any(p[3] == key for p in now.parts):
            return now
        folder, back = self._written(df, checks or {})
        if content_key(back) != (key, n):
            raise Violated("rows changed while they were written")
        number = now.number + 1
        return self._publish(Manifest(number, kind, [*now.parts, (folder, number, now.schema, key)], now.schema, {"rows": n}))

    def overlay(self, df: DataFrame, checks: dict[str, Column] | None = None) -> Manifest:
        """[V10] Records that stand over earlier ones of their keys from now on (``current``); those stay, and come back by a rollback."""
        return self.append(df, checks, "overlay")

    def rollback(self, number: int) -> Manifest:
        """The version of that commit again, as a new one."""
        now, old = self.manifest(), self.manifest(number)
        return self._publish(Manifest(now.number + 1, "rollback", old.parts, old.schema, of=number))

    def migrate(self, to: int) -> Manifest:
        """[V11] From now on the table has schema ``to``: parts written before are mapped as they are read. First each step must
        leave the number of rows, and the keys as a multiset, as they are."""
        now = self.manifest()
        made = now
        for version in range(now.schema + 1, to + 1):
            step = self.migrations[version]
            before = self._read(now, version - 1)
            if before is not None:
                after = self._mapped(before, step)
                names = step.keys_before or step.keys
                old = before.select(*(F.col(f"`{o}`").alias(k) for o, k in zip(names, step.keys, strict=True)))
                was, became = content_key(old), content_key(after.select(*step.keys))
                if was != became:
                    raise Violated(f"schema {version} changes keys: {was[1]} rows before, {became[1]} after")
            made = Manifest(now.number + 1, "migration", now.parts, version, of=now.number)
        return self._publish(made) if made is not now else now

    # ---- reading

    def _mapped(self, df: DataFrame, step: Migration) -> DataFrame:
        return df.select(*(F.expr(e).alias(c) for c, e in step.columns.items()), *(c for c in ("_commit",) if c in df.columns))

    def _read(self, made: Manifest, schema: int) -> DataFrame | None:
        out = None
        by_schema: dict[int, list[tuple[str, int]]] = {}
        for folder, number, version, _ in made.parts:
            by_schema.setdefault(version, []).append((folder, number))
        for version, parts in sorted(by_schema.items()):
            rows = None
            for folder, number in parts:
                one = self.spark.read.parquet(f"{self.path}/{folder}").withColumn("_commit", F.lit(number).cast("long"))
                rows = one if rows is None else rows.unionByName(one)
            for step in range(version + 1, schema + 1):
                rows = self._mapped(rows, self.migrations[step])
            out = rows if out is None else out.unionByName(rows)
        return out

    def read(self, number: int | None = None) -> DataFrame | None:
        """All rows of the present version, or of a commit's, with the commit that brought them (``_commit``)."""
        made = self.manifest(number)
        return self._read(made, made.schema)

    def current(self, keys: list[str], number: int | None = None) -> DataFrame | None:
        """[V10] Of each key the row of the latest commit; of rows of one commit the greatest."""
        rows = self.read(number)
        if rows is None:
            return None
        others = [c for c in rows.columns if c not in (*keys, "_commit")]
        best = rows.groupBy(*keys).agg(F.max(F.struct("_commit", *others)).alias("_row"))
        return best.select(*keys, *(F.col("_row")[c].alias(c) for c in others), F.col("_row")["_commit"].alias("_commit"))
