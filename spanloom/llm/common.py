"""Session, storage and graph helpers shared by the operators here."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a temporary one is made.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends there."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that no later step reads."""
    for df in tables:
        files = df.inputFiles()
        if files:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, longer by as many underscores as it takes to be no column of ``df``."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def per_batch(df: DataFrame, one: Callable[[pa.RecordBatch], Iterable[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` with ``one`` turning each batch into column dicts."""
    from pyspark.sql.types import StructType

    to = _arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cols in one(batch):
                yield as_batch(cols, to)

    return df.mapInArrow(run, schema)


def _arrow_schema(struct) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(struct)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.types import StructType

    return _arrow_schema(StructType.fromDDL(ddl))


def as_batch(cols: dict, to: pa.Schema) -> pa.RecordBatch:
    out = []
    for f in to:
        v = cols[f.name]
        if isinstance(v, pa.ChunkedArray):
            v = v.combine_chunks()
        if not isinstance(v, pa.Array):
            v = pa.array(v, type=f.type, from_pandas=False)
        elif v.type != f.type:
            v = v.cast(f.type)
        out.append(v)
    return pa.RecordBatch.from_arrays(out, schema=to)


def _settled(e: DataFrame) -> bool:
    """Whether every id has one link at most and no link ends in an id that has one."""
    ends = e.select(F.col("u").alias("id"), F.lit(1).alias("own"), F.lit(0).alias("ends")).unionByName(e.select(F.col("v").alias("id"), F.lit(0).alias("own"), F.lit(1).alias("ends")))
    n = ends.groupBy("id").agg(F.sum("own").alias("own"), F.max("ends").alias("ends"))
    return not n.agg(F.count_if((F.col("own") > 1) | ((F.col("own") > 0) & (F.col("ends") > 0)))).first()[0]


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(id, comp)``, comp the smallest id.

    Alternating large-star and small-star steps, each an aggregation with
    map-side combine and a join; every round is written to the shared folder.
    It ends when all links lead to their component's smallest id, so links that
    do so from the start take no round.
    Ids without an edge are absent.  Null ends are dropped; loops are ignored.
    """
    e = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e = written(e, "links")
    for left in range(rounds, -1, -1):
        if _settled(e):
            break
        if not left:
            raise RuntimeError("components did not converge")
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = written(small, "links")
    return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())
