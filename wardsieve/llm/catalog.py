"""All queries of the training-data problems and their SQL."""

from __future__ import annotations

from importlib import import_module

#: Modules of this subpackage that define QUERIES and ORACLES, in order of the problems.
MODULES = ("personal", "nearcopies", "lookalike", "history", "abuse", "calibrate", "cuckoo", "lexicon", "mixture", "level")


def queries() -> dict:
    return {name: f for m in MODULES for name, f in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in import_module(f"{__package__}.{m}").ORACLES.items()}
