"""Operators for preparing language-model training data.

Nothing else in the package imports this subpackage.  ``queries()`` and
``oracle_sql()`` list what ``__spark_entry__`` registers.
"""

from __future__ import annotations


def queries() -> dict:
    from veristrata.llm import catalogue

    return catalogue.queries()


def oracle_sql() -> dict[str, str]:
    from veristrata.llm import catalogue

    return catalogue.oracle_sql()
