"""What driver and executors share: tables that end a lineage, files, and this package's own code."""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """A folder of this session under ``spark.checkpoint.dir``.

    Where that is unset, a local master takes a temporary folder of this machine and any other master the warehouse, unless that is a machine's own disk.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
            root = "file://" + tempfile.mkdtemp(prefix="tidemark-") if local else spark.conf.get("spark.sql.warehouse.dir")
            if not local and root.startswith(("file:", "/")):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _ROOTS[app] = f"{root.rstrip('/')}/tidemark-{uuid.uuid4().hex}"
        atexit.register(_dropped, spark, _ROOTS[app])
    return _ROOTS[app]


def _located(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _dropped(spark: SparkSession, path: str) -> None:
    try:
        place, store = _located(spark, path)
        store.delete(place, True)
    except Exception:  # noqa: BLE001  the session may have ended before
        return


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: iterations neither grow its plan nor repeat its work, and lost executors don't lose it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.kept_in = path
    return made


def forget(df: DataFrame) -> None:
    """Delete a table that ``kept`` wrote, once nothing reads it any more."""
    _dropped(df.sparkSession, df.kept_in)


def kept_text(lines: DataFrame, name: str) -> str:
    """A folder of text files that hold these lines, in their order."""
    path = f"{shared_folder(lines.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    lines.write.option("lineSep", "\r\n").text(path)
    return path


def pieces(spark: SparkSession, path: str, size: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a folder's files one after the other, a piece at a time."""
    place, store = _located(spark, path)
    names = sorted(x.getPath().getName() for x in store.listStatus(place))
    for name in names:
        if name.startswith("part-"):
            stream = store.open(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"))
            try:
                while len(piece := bytes(stream.readNBytes(size))):
                    yield piece
            finally:
                stream.close()


def removed(spark: SparkSession, path: str) -> None:
    _dropped(spark, path)


def stored(spark: SparkSession, name: str, data: bytes) -> str:
    """Write a file into the shared folder; its path."""
    place, store = _located(spark, f"{shared_folder(spark)}/{name}")
    out = store.create(place)
    for at in range(0, len(data), 1 << 20):
        out.write(bytearray(data[at : at + (1 << 20)]))
    out.close()
    return place.toString()


def package_shipped(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once a session, wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(top.rglob("*.py")):
            archive.write(file, file.relative_to(top.parent))
    spark.sparkContext.addPyFile(stored(spark, f"tidemark-{uuid.uuid4().hex[:8]}.zip", packed.getvalue()))
    _SHIPPED.add(app)
