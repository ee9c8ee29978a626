"""All queries of the core, by name, with their SQL. A query without SQL is checked against hand-made rows in the tests."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("text_plans", "source_plans", "corpus_plans", "sampling_plans", "relation_plans", "augment_plans", "evaluation_plans", "security_plans")


def plans() -> dict[str, tuple]:
    out: dict[str, tuple] = {}
    for m in MODULES:
        for name, plan in importlib.import_module(f"lexloom.plans.{m}").PLANS.items():
            if name in out:
                raise ValueError(f"two queries are named {name}")
            out[name] = plan
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in plans().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in plans().items() if sql}
