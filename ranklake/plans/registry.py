"""The queries of the core: name, plan and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.plans: dict[str, Plan] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
        def keep(plan: Plan) -> Plan:
            if name in self.plans:
                raise ValueError(f"two queries named {name}")
            self.plans[name] = plan
            if sql:
                self.sql[name] = sql
            return plan

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
