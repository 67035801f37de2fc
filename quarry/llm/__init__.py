"""Operators that prepare training data. Nothing else in the package imports this one."""

from __future__ import annotations

import sys
from importlib import import_module

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package

PARTS = ("mixing", "substrings", "bpe", "winnow", "chat", "neardup", "rules", "quality", "language", "tokenfile", "alignment", "whitening", "maxscore")


def _parts():
    return [import_module(f"{__name__}.{p}") for p in PARTS]


def queries() -> dict:
    tidy = import_module(f"{__name__}.common").tidy
    return {k: tidy(f) for p in _parts() for k, f in p.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for p in _parts() for k, s in p.ORACLES.items()}
