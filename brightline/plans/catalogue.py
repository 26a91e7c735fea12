"""All named queries of the evidence model, by importing the modules that register them."""

from __future__ import annotations

from brightline.plans import areas, bulletins, feeds, footprints, geometry, instants, ledger, neighbours, provenance, reads, records, rules, streams, texts, thermal  # noqa: F401  they register their queries
from brightline.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
