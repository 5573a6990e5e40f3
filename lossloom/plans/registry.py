"""Query registry: a Spark builder over stage tables next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossloom.plans.sqlchain import with_chain
from lossloom.sources.store import Stages, stages_for


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Stages], DataFrame]
    sql: str | None
    ints: tuple[str, ...]
    r6: tuple[str, ...]
    r2: tuple[str, ...]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.shape(self.build(stages_for(spark, sf_dir)))

    def shape(self, df: DataFrame) -> DataFrame:
        """Whole numbers as long; doubles rounded (ratios to 6, sums of money to 2) and never negative zero."""
        done = {c: F.col(c).cast("long").alias(c) for c in self.ints}
        done |= {c: (F.round(F.col(c).cast("double"), 6) + 0.0).alias(c) for c in self.r6}
        done |= {c: (F.round(F.col(c).cast("double"), 2) + 0.0).alias(c) for c in self.r2}
        return df.select(*[done.get(c, F.col(c)) for c in df.columns])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        swap = [f"{c}::BIGINT AS {c}" for c in self.ints]
        swap += [f"round({c}::DOUBLE, 6) + 0e0 AS {c}" for c in self.r6]
        swap += [f"round({c}::DOUBLE, 2) + 0e0 AS {c}" for c in self.r2]
        star = f"* REPLACE ({', '.join(swap)})" if swap else "*"
        return with_chain(f"SELECT {star} FROM (\n{self.sql}\n) AS q")


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, *, ints: str = "", r6: str = "", r2: str = ""):
    """Register a builder taking Stages. Column lists are space separated."""

    def wrap(build: Callable[[Stages], DataFrame]) -> Callable[[Stages], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, build, sql, tuple(ints.split()), tuple(r6.split()), tuple(r2.split()))
        return build

    return wrap
