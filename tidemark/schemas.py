"""The eight market data sets: schema and business key of each, and the provenance every row carries."""

from __future__ import annotations

import re

from pyspark.sql.types import BooleanType, DateType, DecimalType, LongType, StringType, StructType, TimestampType

PRICE, AMOUNT, RATIO = "decimal(20,6)", "decimal(24,4)", "decimal(20,8)"
PROVENANCE = ["available_at", "source", "source_received_at", "source_payload_sha256", "raw_artifact"]
_PROVENANCE = "available_at timestamp, source string, source_received_at timestamp, source_payload_sha256 string, raw_artifact string"

_COLUMNS = {
    "instruments": ("code string, name string, ipo_date date, out_date date, security_type string, status string", ["code"]),
    "trade_calendar": ("calendar_date date, is_trading_day boolean", ["calendar_date"]),
    "historical_universe": ("snapshot_date date, code string, name string, trade_status boolean", ["snapshot_date", "code"]),
    "index_memberships": ("snapshot_date date, index_code string, member_code string, member_name string", ["snapshot_date", "index_code", "member_code"]),
    "daily_bars": (
        f"trade_date date, code string, adjustment_flag string, open {PRICE}, high {PRICE}, low {PRICE}, close {PRICE}, previous_close {PRICE}, "
        f"volume bigint, amount {AMOUNT}, turnover {RATIO}, trade_status boolean, pct_change {RATIO}, is_st boolean",
        ["trade_date", "code", "adjustment_flag"],
    ),
    "adjustment_factors": (f"code string, effective_date date, forward_factor {RATIO}, backward_factor {RATIO}, adjustment_factor {RATIO}", ["code", "effective_date"]),
    "corporate_actions": (
        f"action_id string, code string, announcement_date date, record_date date, ex_date date, pay_date date, "
        f"cash_before_tax_per_share {RATIO}, stock_dividend_ratio {RATIO}, capitalization_ratio {RATIO}",
        ["action_id"],
    ),
    "five_minute_bars": (
        f"timestamp timestamp, code string, adjustment_flag string, trade_date date, open {PRICE}, high {PRICE}, low {PRICE}, close {PRICE}, volume bigint, amount {AMOUNT}",
        ["timestamp", "code", "adjustment_flag"],
    ),
}

_TYPES = {"string": StringType(), "date": DateType(), "timestamp": TimestampType(), "boolean": BooleanType(), "bigint": LongType(), PRICE: DecimalType(20, 6), AMOUNT: DecimalType(24, 4), RATIO: DecimalType(20, 8)}


def _schema(columns: str) -> StructType:
    out = StructType()
    for name, kind in re.findall(r"(\w+) ([a-z]+(?:\(\d+,\d+\))?)", columns):
        out.add(name, _TYPES[kind])
    return out


SCHEMAS: dict[str, StructType] = {name: _schema(f"{columns}, {_PROVENANCE}") for name, (columns, _) in _COLUMNS.items()}
KEYS: dict[str, list[str]] = {name: keys for name, (_, keys) in _COLUMNS.items()}
#: The adjustment flags of the two price tracks.
SIGNAL, EXECUTION = "2", "3"


def business_columns(dataset: str) -> list[str]:
    return [c for c in SCHEMAS[dataset].names if c not in PROVENANCE]
