"""All queries of the engine by name, each as (spark, sf_dir) -> DataFrame, and the SQL each must equal."""

from __future__ import annotations

from nearbox.plans.reference import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
