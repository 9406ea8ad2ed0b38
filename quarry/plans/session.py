"""Session settings, and the shared folder where lineage is cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Used only where the cluster names no folder of its own (tests, laptops).
LOCAL_CHECKPOINTS = "/tmp/checkpoints/quarry"


def session(app: str = "quarry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC times and adaptive execution; `master` only for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    return builder.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir); only a local master may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or LOCAL_CHECKPOINTS)
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Computes df once into the shared folder; later reads survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
