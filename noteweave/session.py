"""Session helpers: table loading, lineage cuts, bounded broadcast."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the largest size in bytes an estimate may have and still mean anything.
MOST_BITS = 60
#: Rows up to which a dimension whose size has just been counted is broadcast.
BROADCAST_ROWS = 200_000


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per context, so Python workers find it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_noteweave_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="noteweave-package-"), "noteweave-package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(here):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("noteweave", os.path.relpath(full, here)))
    sc.addPyFile(path)
    sc._noteweave_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    ``spark.checkpoint.dir`` wins. Only where it is unset (local tests) a
    temporary folder is made; a cluster without a shared folder is an error.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="noteweave-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it from there.

    The size the optimizer expects is a product over joins. Carried along in a
    loop it grows to millions of digits, until planning takes longer than the
    work, so a senseless size is left behind.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    done = df.checkpoint(eager=True)
    plan = done._jdf.queryExecution()
    if int(str(plan.optimizedPlan().stats().sizeInBytes())).bit_length() <= MOST_BITS:
        return done
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.toRdd(), done._jdf.schema(), False), spark)


def beside(df: DataFrame, row: DataFrame) -> DataFrame:
    """``df`` with the columns of the one-row table ``row``, as a scalar subquery (no join)."""
    one = row.select(F.struct(*row.columns).alias("s")).scalar()
    return df.withColumn("__s", one).select(*df.columns, "__s.*")
