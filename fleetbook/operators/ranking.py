"""Rankings: best / worst days and first car per driver.

Top-k is written as ``orderBy(...).limit(k)``, which Spark plans as
``TakeOrderedAndProject``: each task keeps its own k best rows and only
those reach the final merge, so no task ever sorts the whole input.
"First row per group" is a grouped ``min`` of a struct (partial aggregation)
rather than a window, so a driver with a third of all cars costs one
combined row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetbook.operators.filters import active_only, owner_scope
from fleetbook.scope import IntLike


def top_days(daily: DataFrame, n: int = 3, best: bool = True) -> DataFrame:
    """Best (or worst) ``n`` days by net; ties keep the earlier date first."""
    net = F.col("net").desc() if best else F.col("net").asc()
    return daily.orderBy(net, F.col("entry_date").asc()).limit(n)


def best_days(daily: DataFrame, n: int = 3) -> DataFrame:
    return top_days(daily, n, best=True)


def worst_days(daily: DataFrame, n: int = 3) -> DataFrame:
    return top_days(daily, n, best=False)


def first_car(cars: DataFrame, owner: IntLike) -> DataFrame:
    """For each current driver, the first active car of the owner in label
    order (brand, model, plate, then id)."""
    c = active_only(owner_scope(cars, owner)).where(F.col("current_driver_id").isNotNull())
    first = F.min(F.struct("brand", "model", "plate", "id")).alias("f")
    return (c.groupBy("current_driver_id").agg(first)
             .select("current_driver_id", F.col("f.id").alias("car_id"),
                     F.col("f.brand").alias("brand"), F.col("f.model").alias("model"),
                     F.col("f.plate").alias("plate")))
