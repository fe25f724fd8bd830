"""Session helpers: column access, shared scratch tables and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """A column by its literal name, also when the name holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python functions run where it is not installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="gleanframe-")) / "gleanframe.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(at))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    ``spark.checkpoint.dir`` names it on a cluster; only where that is unset (local tests) a folder of our own is made.
    """
    sc = spark.sparkContext
    jsc = sc._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="gleanframe-")
    sc.setCheckpointDir(configured)
    return jsc.getCheckpointDir().get()


def materialize(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` does, but compressed and with column pruning on later reads; survives the loss of any
    executor. The table lives as long as the shared folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gleanframe_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table of :func:`materialize` that no later plan reads."""
    path = getattr(df, "_gleanframe_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Partitioned by the keys into as many tasks as the session asks for.

    Adaptive execution joins small shuffles into few tasks by their bytes; before work that is heavy for its bytes the number is given.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *[col(k) for k in keys])
