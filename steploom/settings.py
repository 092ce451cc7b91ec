"""Session settings that suit the library's plans; none is needed for right results."""

from __future__ import annotations

from pyspark.sql import SparkSession

RECOMMENDED = {
    # Conversions of many columns generate long methods, and the JVM does not compile methods above
    # 8000 bytes by default. Without fusing the whole stage Spark splits the code into short ones.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Joins on the ID are sized, and skewed partitions split, at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def apply_recommended(spark: SparkSession) -> SparkSession:
    for name, value in RECOMMENDED.items():
        spark.conf.set(name, value)
    return spark
