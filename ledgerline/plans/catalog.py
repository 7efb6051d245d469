"""All registered queries."""

from ledgerline.plans import (  # noqa: F401
    ledger_queries, mirror_queries, pacing_queries, reading_queries, rollup_queries, rule_queries, store_queries, stream_queries)
from ledgerline.plans.registry import ORACLES, QUERIES  # noqa: F401
