"""What the operators share: cutting lineage, spare column names and the word rule."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a word is a run of anything but space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The folder in spark.checkpoint.dir holds. Only where none is set and all tasks run on this machine, a local one is made."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="cuelake-ck-")
        sc.setCheckpointDir(folder)


def spare(columns: list[str], *stems: str) -> list[str]:
    """A name for each stem that no column has, so that added columns never meet those of the input."""
    taken = {c.lower() for c in columns}
    out = []
    for stem in stems:
        name = f"_{stem}"
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def delete_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever it lies."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
