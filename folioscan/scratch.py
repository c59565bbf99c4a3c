"""Written tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a written table that a part file should hold, where their number is known beforehand.
ROWS_A_FILE = 200_000
#: By application: what local mode uses where the session names no folder.
_local: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where that is unset a temporary one in local mode, as in tests; an error elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = "file://" + tempfile.mkdtemp(prefix="folioscan-")
        found = _local[app]
    return found.rstrip("/")


class Scratch:
    """A folder of written tables below the shared folder, removed when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/folioscan-{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.written: list[tuple[DataFrame, str]] = []
        atexit.register(self.remove)

    def path(self, name: str) -> str:
        """A path of its own below the folder."""
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def table(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Writes df as Parquet and reads it back: later steps restart from the files if executors are lost.

        rows: how many rows df has at most, if that is known; few rows go to few files, not to one for each shuffle partition.
        """
        if rows is not None and (files := max(1, -(-rows // ROWS_A_FILE))) < int(self.spark.conf.get("spark.sql.shuffle.partitions", "200")):
            df = df.coalesce(files)
        path = self.path(name)
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.written.append((table, path))
        return table

    def keep(self, *tables: DataFrame) -> None:
        """Deletes all tables written so far but these."""
        for table, path in self.written:
            if not any(table is t for t in tables):
                self._delete(path)
        self.written = [x for x in self.written if any(x[0] is t for t in tables)]

    def drop(self, *tables: DataFrame) -> None:
        """Deletes written tables that nothing will read again."""
        for t in tables:
            for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
                self._delete(path)

    def remove(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session is already gone; the folder is left to its owner
            pass
