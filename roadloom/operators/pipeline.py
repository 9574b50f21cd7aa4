"""Stage runner: functions from tables to tables, in order, with versioned outputs and a snapshot of the parameters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field, is_dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.sources.store import config_snapshot, required

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Config:
    """The defaults of all stages."""

    version_id: str = "v1"
    grid_types: tuple[str, ...] = ("square", "hex", "voronoi")
    buffer_m: float = 50.0
    pixel_m: float = 5.0
    cell_m: float = 3000.0
    match_radii_m: tuple[float, ...] = (60.0, 180.0, 600.0)
    sample_step_m: float = 30.0
    theta: float = 6.83
    alpha: float = -0.12
    beta: float = -0.10
    lam: float = 0.15
    damping: float = 0.35


@dataclass
class Stage:
    name: str
    run: Callable[[SparkSession, Tables, Config], Tables]
    needs: tuple[str, ...] = ()


@dataclass
class Pipeline:
    stages: list[Stage] = field(default_factory=list)

    def between(self, first: str | None, last: str | None) -> list[Stage]:
        """The stages from `first` to `last`, both included; a wrong order or name raises ValueError."""
        names = [s.name for s in self.stages]
        a, b = names.index(first) if first else 0, names.index(last) if last else len(names) - 1
        if a > b:
            raise ValueError(f"{first} is after {last}")
        return self.stages[a : b + 1]

    def run(self, spark: SparkSession, root: str, config: Config, tables: Tables | None = None, first: str | None = None, last: str | None = None) -> Tables:
        """Run stages; each one's tables are written under root/version_id and read again by the next."""
        known = dict(tables or {})
        base = f"{root}/{config.version_id}"
        for s in self.between(first, last):
            for n in s.needs:
                if n not in known:
                    required(spark, f"{base}/{n}")
                    known[n] = spark.read.parquet(f"{base}/{n}")
            for n, df in s.run(spark, known, config).items():
                df.withColumn("version_id", F.lit(config.version_id)).write.mode("overwrite").parquet(f"{base}/{n}")
                known[n] = spark.read.parquet(f"{base}/{n}")
            config_snapshot(spark, f"{base}/_config/{s.name}", asdict(config) if is_dataclass(config) else dict(config))
        return known


def by_grid_type(tables: dict[str, DataFrame]) -> DataFrame:
    """O2: one table for all kinds of grid, told apart by a column that writers can partition by."""
    out = None
    for kind, df in tables.items():
        one = df.withColumn("grid_type", F.lit(kind))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def compared(versions: dict[str, DataFrame]) -> DataFrame:
    """One-row metrics of versions side by side; metrics that a version lacks are null."""
    out = None
    for name, df in versions.items():
        one = df.limit(1).withColumn("version_id", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
