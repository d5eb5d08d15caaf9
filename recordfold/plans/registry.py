"""Collects the registered queries of every plan module."""
from __future__ import annotations

import importlib

MODULES = ("queries", "q_access", "q_records", "q_reshape", "q_rules", "q_eval", "q_stream")


def _load():
    for m in MODULES:  # a missing module is an error, not fewer queries
        importlib.import_module(f"recordfold.plans.{m}")
    return importlib.import_module("recordfold.plans.queries")


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLE)
