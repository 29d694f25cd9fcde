"""Session defaults of the engine."""

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(app: str = "clipsieve", **conf: str) -> SparkSession:
    """A session with the engine's defaults; conf overrides them, with _ for . in names."""
    return SparkSession.builder.appName(app).config(map=DEFAULTS | {k.replace("_", "."): v for k, v in conf.items()}).getOrCreate()
