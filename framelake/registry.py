"""Every query of the library by name, with its SQL oracle."""

from __future__ import annotations

import importlib

FLAGSHIP = "easy_studio"
TOPICS = ("colors", "mattes", "temporals", "stencils", "layouts", "editing", "guides", "rasters", "looks", "pipelines")


def _load():
    for topic in TOPICS:
        importlib.import_module(f"framelake.plans.{topic}")
    return importlib.import_module("framelake.plans.base")


def queries() -> dict:
    return dict(_load().QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_load().ORACLES)
