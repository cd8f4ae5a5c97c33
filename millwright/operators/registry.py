"""Machine registry and the lookup of a message's machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def active_machines(machines: DataFrame) -> DataFrame:
    return machines.where(F.col("is_active") & F.col("company_id").isNotNull())


def registry_join(messages: DataFrame, machines: DataFrame, key: str = "api_key") -> DataFrame:
    """Messages of registered machines, with the machine's columns.

    Left to Catalyst and AQE: the registry is broadcast when its measured size
    is under the threshold, else joined by a shuffle whose hot keys AQE splits.
    """
    return messages.join(active_machines(machines), key, "inner")


def unknown_machines(messages: DataFrame, machines: DataFrame, key: str = "api_key") -> DataFrame:
    return messages.join(active_machines(machines).select(key), key, "left_anti")
