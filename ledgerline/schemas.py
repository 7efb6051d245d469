"""Schemas of the ledger's tables and of the snapshot documents.

Counters in documents are STRING on purpose: exports carry them as numbers or
as quoted text, and both are accepted.
"""

from __future__ import annotations

_FIVE = "inputTokens string, outputTokens string, cacheReadTokens string, cacheCreationTokens string, totalTokens string"
_COSTS = "totalCost string, costUSD string, cost string"
MODEL_ROW = f"struct<modelName: string, model: string, {_FIVE.replace(' string', ': string')}, {_COSTS.replace(' string', ': string')}>"
_AGENT_FIELDS = (
    f"agent: string, {_FIVE.replace(' string', ': string')}, {_COSTS.replace(' string', ': string')}, "
    f"modelBreakdowns: array<{MODEL_ROW}>, breakdown: map<string, {MODEL_ROW}>"
)
_DAY = f"struct<period: string, date: string, {_AGENT_FIELDS}, agents: array<struct<{_AGENT_FIELDS}>>>"
_SESSION = (
    f"struct<period: string, sessionId: string, session: string, agent: string, {_FIVE.replace(' string', ': string')}, "
    f"{_COSTS.replace(' string', ': string')}, modelsUsed: array<string>, models: array<string>, "
    "firstActivity: string, lastActivity: string, projectPath: string, "
    "metadata: struct<agent: string, firstActivity: string, lastActivity: string, projectPath: string>>"
)

SNAPSHOT = (
    f"daily array<{_DAY}>, type string, data array<{_DAY}>, session array<{_SESSION}>, "
    f"sessions array<{_SESSION}>, sessionReport struct<sessions: array<{_SESSION}>>, "
    f"totals struct<{_FIVE.replace(' string', ': string')}>"
)

READING_PAYLOAD = (
    "usage struct<monthly: struct<status: string, percent: double, resetsAt: string>>"
)

_COUNTERS = (
    "input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, cache_creation_tokens bigint, "
    "reported_total_tokens bigint, accounting_delta_tokens bigint, reported_cost_usd decimal(38,12)"
)
DAILY = f"id string, machine_id string, import_id string, agent string, usage_date date, {_COUNTERS}, is_tombstone boolean, usage_hash string"
MODEL_DAILY = DAILY.replace("agent string, ", "agent string, model string, ")
SESSIONS = (
    "machine_id string, import_id string, agent string, session_id string, first_activity timestamp, "
    f"last_activity timestamp, {_COUNTERS}, models array<string>, local_key_hash string, identity_hash string, "
    "mirror_hash string, session_hash string"
)
IMPORTS = (
    "import_id string, machine_id string, raw_sha256 string, scope_start date, scope_end date, status string, "
    "created_at timestamp, processed_at timestamp"
)
MACHINES = "machine_id string, name string, is_active boolean"
LINKS = (
    "observation_id string, canonical_observation_id string, canonical_machine_id string, reason string, "
    "matched_session_count bigint, session_overlap_ratio double"
)
RECOVERED = (
    "set_id string, month date, agent string, input_tokens bigint, output_tokens bigint, cache_creation_tokens bigint, "
    "cache_read_tokens bigint, total_tokens bigint, reported_cost_usd decimal(38,12), models array<string>"
)
RECOVERED_SETS = (
    "set_id string, accounting_mode string, pricing_complete boolean, total_input_tokens bigint, "
    "total_output_tokens bigint, total_cache_creation_tokens bigint, total_cache_read_tokens bigint, "
    "total_tokens bigint, reported_cost_usd decimal(38,12)"
)
READINGS = (
    "account string, observed_at timestamp, fetched_at timestamp, fraction decimal(9,4), status string, "
    "provider_resets_at timestamp, reading_id bigint"
)
CONTRACTS = (
    "contract_id string, account string, created_at timestamp, status string, tracking_start timestamp, reset_at timestamp, "
    "check_time string, baseline double, hard_limit double, safety_reserve double"
)
CELLS = "workbook_id string, row int, col int, value string"
