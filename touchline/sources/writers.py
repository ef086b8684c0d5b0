"""Writers. Every target is checked before the first byte is written; nothing is overwritten, and a failure leaves nothing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline import settings
from touchline.operators import cleaning
from touchline.session import stage


def _located(spark: SparkSession, path: str) -> tuple:
    """File system and path as Spark itself would open them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def require_absent(spark: SparkSession, paths: Sequence[str]) -> None:
    """Fail if any target exists, before anything is written."""
    taken = [p for p in paths if (at := _located(spark, p))[0].exists(at[1])]
    if taken:
        raise FileExistsError(f"not overwritten: {', '.join(taken)}")


def publish(spark: SparkSession, parts: Mapping[str, Callable[[str], None]]) -> None:
    """Write all targets or none. ``parts`` maps a target to a function that writes it to a given path.

    Every part is written beside its target under a hidden name; once all are whole they are renamed in the given order, so the
    last one (a manifest) says that the others stand. After a failure in either phase no part and no target is left. On
    a store whose renames are copies the second phase takes as long as copying.
    """
    require_absent(spark, list(parts))
    run = uuid.uuid4().hex
    beside = {target: "{}{}_{}-{}".format(*target.rstrip("/").rpartition("/"), run) for target in parts}
    renamed = []
    try:
        for target, write in parts.items():
            write(beside[target])
        require_absent(spark, list(parts))  # another writer may have been faster
        for target in parts:
            files, to = _located(spark, target)
            if not files.rename(_located(spark, beside[target])[1], to):
                raise OSError(f"not renamed: {target}")
            renamed.append(target)
    except BaseException:
        for path in [*renamed, *beside.values()]:
            files, at = _located(spark, path)
            files.delete(at, True)
        raise


def finite(value: Column) -> Column:
    """NaN and infinities become NULL, as JSON has neither."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def finite_columns(df: DataFrame) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: finite(F.col(c)) for c in doubles})


def manifest(
    rows: DataFrame, low: float = settings.OVERROUND_MIN, high: float = settings.OVERROUND_MAX,
    aliases: Mapping[str, str] = settings.CLEAN_ALIASES, timestamp: datetime | None = None,
) -> DataFrame:
    """One row that describes a sanitising run."""
    stats = cleaning.sanitise_stats(rows).select("input_rows", "output_rows", "excluded_rows", F.lit(1).alias("_one"))
    reasons = cleaning.exclusion_counts(rows).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "rows")))).alias("exclusion_reasons"),
        F.lit(1).alias("_one"),
    )
    table = F.create_map(*[F.lit(v) for pair in aliases.items() for v in pair]) if aliases else F.create_map()
    return stats.join(reasons, "_one").select(
        F.lit(1).alias("schema_version"), F.lit(True).alias("read_only_originals"),
        F.lit((timestamp or datetime.now()).isoformat()).alias("timestamp"),
        "input_rows", "output_rows", "excluded_rows", "exclusion_reasons", table.alias("alias_map"),
        F.struct(F.lit(low).alias("min"), F.lit(high).alias("max")).alias("overround_range"),
    )


# Names of the four outputs of a sanitising run.
SANITISE_OUTPUTS = ("historico_saneado", "excluidos", "manifiesto", "estadisticas")


def write_sanitised(rows: DataFrame, folder: str, **limits) -> dict[str, str]:
    """Clean rows, excluded rows, statistics and, last, the manifest; all or nothing."""
    # Worked out once: each of the four outputs would read and judge every row again, twice where it filters by the judgement.
    rows = stage(rows)
    clean, excluded = cleaning.split_outputs(rows)
    as_csv = lambda df: lambda path: df.write.option("header", "true").csv(path)
    writes = {
        SANITISE_OUTPUTS[0]: as_csv(clean), SANITISE_OUTPUTS[1]: as_csv(excluded),
        SANITISE_OUTPUTS[3]: lambda path: finite_columns(cleaning.sanitise_stats(rows)).write.json(path),
        SANITISE_OUTPUTS[2]: lambda path: manifest(rows, **limits).write.json(path),
    }
    publish(rows.sparkSession, {f"{folder}/{name}": write for name, write in writes.items()})
    return {name: f"{folder}/{name}" for name in SANITISE_OUTPUTS}


def write_backtest(predictions: DataFrame, metrics: DataFrame, folder: str) -> dict[str, str]:
    """Predictions partitioned by season and the metrics table as JSON; all or nothing."""
    paths = {"predictions": f"{folder}/predictions", "metrics": f"{folder}/metrics"}
    publish(predictions.sparkSession, {
        paths["predictions"]: lambda path: predictions.write.partitionBy("season").parquet(path),
        paths["metrics"]: lambda path: finite_columns(metrics).write.json(path),
    })
    return paths


def write_matchdays(packages: DataFrame, folder: str) -> str:
    """Packages, contracts or predictions as JSON, one folder per matchday."""
    publish(packages.sparkSession, {folder: lambda path: packages.write.partitionBy("jornada").json(path)})
    return folder


def write_missing(rows: DataFrame, folder: str) -> str:
    ordered = rows.orderBy("date", "division", "home")
    publish(rows.sparkSession, {folder: lambda path: ordered.write.option("header", "true").csv(path)})
    return folder


def fingerprints(files: DataFrame) -> DataFrame:
    """SHA-256 of every file (path, content)."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def combined_fingerprint(prints: DataFrame) -> DataFrame:
    """One hash over all file hashes in path order; one short row per file is gathered."""
    ordered = F.array_sort(F.collect_list(F.struct("path", "sha256")))
    joined = F.array_join(F.transform(ordered, lambda f: f["sha256"]), "")
    return prints.agg(F.count(F.lit(1)).alias("files"), F.sha2(joined, 256).alias("combined"))
