"""Writers: per-section results, extraction cache, diagnostics bundle, exchange files."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import KeyedStore


def save_results(comparisons: DataFrame, path: str, keys: Sequence[str] = ("section",)) -> int:
    """Comparison rows of the sections in ``comparisons`` replace what is stored for them; all others stay."""
    return KeyedStore(comparisons.sparkSession, path, keys).replace(comparisons)


def save_extraction(benches: DataFrame, path: str, keys: Sequence[str] = ("section", "kind")) -> int:
    """Extracted benches, unique per section and kind (and session, where ``keys`` name it)."""
    return KeyedStore(benches.sparkSession, path, keys).replace(benches)


def read_results(spark: SparkSession, path: str, section: str | None = None, keys: Sequence[str] = ("section",)) -> DataFrame:
    """Stored rows; a section reads only its own bucket."""
    return KeyedStore(spark, path, keys).read(**({} if section is None else {"section": section}))


def write_diagnostics(report, path: str, warnings: DataFrame | None = None, spatial: DataFrame | None = None, config: dict | None = None) -> list[str]:
    """One dataset per diagnostics table of a hole report under ``path``; returns the names written."""
    tables = {"accepted": report.accepted.withColumn("extras", F.to_json("extras")), "rejections": report.rejections, "summary": report.summary}
    if warnings is not None:
        tables["warnings"] = warnings
    if spatial is not None:
        tables["spatial"] = spatial
    if config:
        spark = report.annotated.sparkSession
        tables["configuration"] = spark.createDataFrame([(k, str(v)) for k, v in config.items()], "name string, value string")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    return list(tables)


def write_rejections(report, path: str, config: dict | None = None) -> None:
    """Rejected rows as CSV with a one-row metadata dataset beside them."""
    report.rejections.write.mode("overwrite").csv(f"{path}/rejected_rows", header=True)
    meta = report.summary.withColumns({k: F.lit(str(v)) for k, v in (config or {}).items()})
    meta.write.mode("overwrite").csv(f"{path}/metadata", header=True)


def write_exchange_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)
