"""Constraints at write time: what breaks a table's declaration is set aside with its reasons, in the pass that writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from plenum.sources.schemas import TABLES


def rules_of(columns: list[str], name: str, others: dict[str, DataFrame] | None = None) -> list[str]:
    """The names of the rules that judged() looks at, in order."""
    table = TABLES[name]
    found = [f"{f.name} is null" for f in table.schema if not f.nullable and f.name in columns]
    found += [f"{c} is not allowed" for c in table.checks] + [f"{' '.join(key)} is taken" for key in table.unique]
    return found + [f"{column} is not in {other}" for column, other in table.references.items() if others and other in others]


def judged(rows: DataFrame, name: str, others: dict[str, DataFrame] | None = None, *order: Column) -> DataFrame:
    """rows with _reasons: the rules of the declaration that a row breaks, in their order; empty for a good row.

    Rules: columns that must not be null, allowed values, keys (of rows that
    share one, the first by ``order`` is good; null in a key never clashes), and references to the given
    tables. The rows are read once: a key is a running number inside of its
    sorted rows, a reference one join with the other table's ids.
    """
    table = TABLES[name]
    broken = [F.col(f.name).isNull() for f in table.schema if not f.nullable and f.name in rows.columns]
    broken += [F.col(c).isNotNull() & ~F.col(c).isin(list(values)) for c, values in table.checks.items()]
    out = rows
    for i, key in enumerate(table.unique):
        place = F.row_number().over(Window.partitionBy(*key).orderBy(*(order or [F.col(c) for c in key])))
        out = out.withColumn(f"_place_{i}", place)
        whole = F.lit(True)
        for c in key:
            whole = whole & F.col(c).isNotNull()
        broken.append(whole & (F.col(f"_place_{i}") > 1))
    for i, (column, other) in enumerate(table.references.items()):
        if others and other in others:
            known = others[other].select(F.col("id").alias(column)).distinct().withColumn(f"_known_{i}", F.lit(True))
            out = out.join(known, column, "left")
            broken.append(F.col(column).isNotNull() & F.col(f"_known_{i}").isNull())
    names = rules_of(rows.columns, name, others)
    reasons = F.filter(F.array(*[F.when(met, F.lit(rule)) for rule, met in zip(names, broken, strict=True)]), lambda r: r.isNotNull())
    return out.withColumn("_reasons", reasons).select(*rows.columns, "_reasons")


def write(rows: DataFrame, name: str, path: str, others: dict[str, DataFrame] | None = None, *order: Column) -> dict[str, int]:
    """Writes rows under path, the good ones in accepted=true and the others in accepted=false, and returns how many there are, how many were accepted, and how many broke each rule.

    Everything is one job over one scan of rows; the counts are metrics of that job.
    """
    found = judged(rows, name, others, *order)
    metrics = Observation()
    per_rule = [F.count_if(F.array_contains("_reasons", rule)).alias(rule) for rule in rules_of(rows.columns, name, others)]
    counts = found.observe(metrics, F.count(F.lit(1)).alias("rows"), F.count_if(F.size("_reasons") == 0).alias("accepted"), *per_rule)
    counts.withColumn("accepted", F.size("_reasons") == 0).write.mode("errorifexists").partitionBy("accepted").parquet(path)
    return dict(metrics.get)


def accepted(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).filter("CAST(accepted AS BOOLEAN)").drop("accepted", "_reasons")


def quarantined(spark, path: str) -> DataFrame:
    """The rows that were set aside, with _reasons."""
    return spark.read.parquet(path).filter("NOT CAST(accepted AS BOOLEAN)").drop("accepted")
