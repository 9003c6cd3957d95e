"""Tables whose changes become visible at once: data goes to new folders, a small file names those that count.

A table folder holds ``data/`` and ``_log/``. A writer fills a folder below ``data/`` and then puts one entry into the log (written beside it and renamed),
so a reader that follows the log sees whole writes only; a write that fails leaves a folder that nobody names. Works on every file system Spark writes to.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Log:
    """The entries of one table, by name; ``entries`` is what counts now."""

    def __init__(self, spark: SparkSession, table: str):
        self.spark, self.table = spark, table.rstrip("/")
        jvm, self._open = spark.sparkContext._jvm, spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.table).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.table}/{folder}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def entries(self) -> dict[str, dict]:
        """Committed entries in the order of their names."""
        out = {}
        for name in self._names("_log"):
            if name.endswith(".json") and not name.startswith((".", "_")):
                stream = self.fs.open(self._path(f"{self.table}/_log/{name}"))
                out[name.removesuffix(".json")] = json.loads(self._open.toString(stream, "UTF-8"))
                stream.close()
        return out

    def commit(self, name: str, entry: dict) -> None:
        """Make ``entry`` visible. An entry of the same name is replaced."""
        end, draft = self._path(f"{self.table}/_log/{name}.json"), self._path(f"{self.table}/_log/.{name}-{uuid.uuid4().hex}")
        out = self.fs.create(draft, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if self.fs.exists(end):
            self.fs.delete(end, False)
        if not self.fs.rename(draft, end):
            raise OSError(f"could not commit {end}")

    def forget(self, names: list[str]) -> None:
        for n in names:
            self.fs.delete(self._path(f"{self.table}/_log/{n}.json"), False)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def publish(self, rows: DataFrame, folder: str) -> None:
        """Write ``rows`` and give them their name in one step, unless it is taken by an earlier attempt that went well."""
        if self.exists(folder):
            return
        draft = f"{self.table}/_new-{uuid.uuid4().hex}"
        rows.write.parquet(draft)
        self.fs.mkdirs(self._path(folder).getParent())
        if not self.fs.rename(self._path(draft), self._path(folder)):
            raise OSError(f"could not publish {folder}")

    def folders(self) -> list[str]:
        return [f"{self.table}/data/{n}" for n in self._names("data")]

    def remove(self, folders: list[str]) -> None:
        for f in folders:
            self.fs.delete(self._path(f), True)


# --- batches of a stream --------------------------------------------------------------------------------

class Batches:
    """A table made of the micro-batches of one or more runs, folded into a snapshot now and then.

    ``append`` is idempotent: a batch that was committed before a failure is skipped when the stream repeats it, one that was not is written anew. After
    ``every`` batches the table is rewritten by ``fold`` into one folder, named by a snapshot entry that also says which batches it covers. Folders
    that the last two snapshots don't need go, so their number is bounded while readers of the last state can finish.
    """

    def __init__(self, spark: SparkSession, table: str, fold: Callable[[DataFrame], DataFrame] | None = None, every: int = 16):
        self.log, self.spark, self.fold, self.every = Log(spark, table), spark, fold or (lambda d: d), every

    def _now(self) -> tuple[dict | None, dict[str, dict]]:
        entries = self.log.entries()
        snapshots = [e for n, e in entries.items() if n.startswith("snapshot-")]
        last = snapshots[-1] if snapshots else None
        return last, {n: e for n, e in entries.items() if n.startswith("batch-") and not self._covered(last, e["run"], e["batch"])}

    @staticmethod
    def _covered(last: dict | None, run: int, batch: int) -> bool:
        """A run commits its batches in order, so the last one in a snapshot says which are in it."""
        return last is not None and batch <= last["runs"].get(str(run), -1)

    def append(self, rows: DataFrame, run: int, batch: int) -> None:
        name = f"batch-{run:08d}-{batch:012d}"
        last, open_ = self._now()
        if name in open_ or self._covered(last, run, batch):
            return
        folder = f"{self.log.table}/data/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        self.log.commit(name, {"folder": folder, "run": run, "batch": batch})
        if len(open_) + 1 >= self.every:
            self.compact()

    def read(self, schema) -> DataFrame:
        """The rows of every committed batch."""
        last, open_ = self._now()
        folders = [e["folder"] for e in ([last] if last else []) + list(open_.values())]
        reader = self.spark.read.schema(schema)
        return reader.parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def compact(self) -> None:
        entries = self.log.entries()
        last, open_ = self._now()
        if not open_:
            return
        runs = dict(last["runs"]) if last else {}
        for e in open_.values():
            runs[str(e["run"])] = max(runs.get(str(e["run"]), -1), e["batch"])
        number = last["number"] + 1 if last else 0
        folder = f"{self.log.table}/data/snapshot-{number:012d}-{uuid.uuid4().hex}"
        first = next(iter(open_.values()))["folder"]
        self.fold(self.read(self.spark.read.parquet(first).schema)).write.parquet(folder)
        self.log.commit(f"snapshot-{number:012d}", {"folder": folder, "number": number, "runs": runs})
        # a reader may still hold the state before this one: the last snapshot and the batches open until now
        before = {n for n in entries if n.startswith("snapshot-")}
        gone = [n for n in entries if n not in open_ and n not in sorted(before)[-1:]]
        self.log.forget(gone)
        self.log.remove([entries[n]["folder"] for n in gone])


# --- several tables at once -----------------------------------------------------------------------------

def write_together(spark: SparkSession, root: str, **tables: DataFrame) -> None:
    """Replace several tables in one step: all new folders are written first, then one manifest names them. A failure
    before that leaves the old state of all of them. Tables that aren't given stay as they are."""
    log = Log(spark, root)
    manifests = log.entries()
    number = int(max(manifests, default="-1").removeprefix("manifest-")) + 1
    now = dict(manifests[max(manifests)]) if manifests else {}
    new = {}
    for name, rows in tables.items():
        new[name] = {"folder": f"{log.table}/data/{name}-{uuid.uuid4().hex}", "schema": rows.schema.json()}
        rows.write.parquet(new[name]["folder"])
    log.commit(f"manifest-{number:012d}", now | new)
    older = sorted(manifests)[:-1]  # the state before this one stays for readers that hold it
    kept = {e["folder"] for n, m in log.entries().items() if n not in older for e in m.values()}
    log.remove(sorted({e["folder"] for n in older for e in manifests[n].values()} - kept))
    log.forget(older)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table as the last manifest has it."""
    from pyspark.sql.types import StructType
    manifests = Log(spark, root).entries()
    entry = manifests[max(manifests)][name]
    return spark.read.schema(StructType.fromJson(json.loads(entry["schema"]))).parquet(entry["folder"])
