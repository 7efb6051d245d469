"""Fixed thresholds of the ledger, gathered in one frozen object.

Fixed values: they decide which rows are accepted, stored or linked, so they
are stated plainly and can be replaced per call.
"""

from __future__ import annotations

from dataclasses import dataclass

ALL = "all"
RECOVERED_MACHINE = "recovered-machine"
RECOVERED_MACHINE_NAME = "Recovered machine"

IMPORT_STATUSES = ("processing", "processed", "exact_duplicate", "failed")
LINK_REASONS = ("exact_raw_snapshot", "exact_daily_with_session_evidence")
ACCOUNTING_MODES = ("evidence_only_non_additive", "additive_recovered")


@dataclass(frozen=True)
class Limits:
    max_counter: int = 9007199254740991
    max_snapshot_bytes: int = 8 * 1024 * 1024
    max_workbook_bytes: int = 4 * 1024 * 1024
    max_agent_chars: int = 128
    max_model_chars: int = 256
    max_session_chars: int = 512
    max_path_chars: int = 4096
    lookback_days: int = 3
    stale_import_minutes: int = 15
    min_session_matches: int = 2
    min_session_overlap: float = 0.8
    live_seconds: int = 5 * 60
    recent_seconds: int = 30 * 60
    sync_stale_seconds: int = 30 * 60
    near_plan_headroom: float = 0.02
    headroom_lower_eps: float = -1e-12
    headroom_upper_eps: float = 1e-9
    near_limit_headroom: float = 0.02
    cooldown_seconds: int = 45
    auto_refresh_seconds: int = 2 * 60
    heartbeat_seconds: int = 60 * 60
    reset_tolerance_seconds: int = 60
    rollover_min_advance_seconds: int = 24 * 60 * 60
    formula_tolerance: float = 1e-6
    max_formula_details: int = 50
    recovered_cost_tolerance: str = "0.005"


LIMITS = Limits()
