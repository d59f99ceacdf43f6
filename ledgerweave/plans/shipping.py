"""Lets Python workers find this package where it is installed on the driver."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from pathlib import Path

import ledgerweave

ROOT = str(Path(ledgerweave.__file__).resolve().parent.parent)


def ship(spark) -> None:
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(":")
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *[p for p in paths if p]])


def shipped(query: Callable) -> Callable:
    @wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run
