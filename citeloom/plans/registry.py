"""Collects the registered queries of all theme modules once."""

from __future__ import annotations

from functools import lru_cache

from citeloom.plans import Registry
from citeloom.plans import documents, evidence, indexes, live, ranking, records, stores, tasks

MODULES = (ranking, evidence, records, documents, live, tasks, stores, indexes)


@lru_cache(maxsize=1)
def collect() -> Registry:
    reg = Registry()
    for module in MODULES:
        module.add(reg)
    return reg
