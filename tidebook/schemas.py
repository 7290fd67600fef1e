"""Schemas of the stored tables, as DDL; keys and how each may change."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Table:
    """columns: DDL. key: unique columns. mode: upsert (last write wins), append, first (first write wins), replace."""

    columns: str
    key: tuple[str, ...]
    mode: str = "append"


PRICES = "instrument_id long, date date, as_of_date date, open double, high double, low double, close double, volume double, adjusted boolean, source string"

TABLES: dict[str, Table] = {
    "instruments": Table("id long, ticker string, name string, sector string, isin string, is_index boolean, listed_from date, delisted_on date", ("ticker",), "upsert"),
    "prices": Table(PRICES, ("instrument_id", "date", "adjusted"), "upsert"),
    "strategies": Table("id long, name string, version int, config string", ("name", "version"), "upsert"),
    "decisions": Table("id long, user_id string, instrument_id long, decision_date date, fill_date date, action string, features string", ("id",)),
    "positions": Table("id long, user_id string, instrument_id long, qty long, entry_price double, stop_price double, status string", ("id",), "upsert"),
    "trades": Table("id long, user_id string, instrument_id long, side string, qty long, price double, fee double, ts timestamp", ("id",)),
    "equity_curve": Table("user_id string, date date, equity double, cash double, exposure double", ("user_id", "date"), "upsert"),
    "index_membership": Table("index_name string, instrument_id long, date_from date, date_to date, source string", ("index_name", "instrument_id", "date_from"), "replace"),
    "corporate_actions": Table("instrument_id long, action_type string, ex_date date, value_or_ratio double", ("instrument_id", "action_type", "ex_date"), "replace"),
    "strategy_trials": Table("id long, config_hash string, run_at timestamp, metrics string", ("id",)),
    "overrides": Table("id long, decision_id long, reason string, at timestamp", ("id",)),
    "fundamentals": Table("instrument_id long, as_of_date date, period string, pe double, pb double, roe double, debt_equity double, revenue_yoy double", ("instrument_id", "as_of_date"), "upsert"),
    "llm_calls": Table("id long, input_hash string, model string, at timestamp, tokens_in long, tokens_out long, ok boolean", ("id",)),
    "llm_cache": Table("input_hash string, response string, at timestamp", ("input_hash",), "first"),
    "llm_features": Table("instrument_id long, as_of_date date, llm_score double, label string, confidence double", ("instrument_id", "as_of_date"), "upsert"),
    "llm_costs": Table("id long, at timestamp, usd double", ("id",)),
    "llm_runs": Table("id long, at timestamp, processed long, failed long", ("id",)),
    "paper_state": Table("user_id string, cash double, peak_equity double, last_settled_date date, config_hash string", ("user_id",), "upsert"),
    "paper_orders": Table("id long, user_id string, instrument_id long, side string, qty long, stop_price double, decision_date date, fill_date date, status string", ("id",), "upsert"),
    "prices_intraday": Table("instrument_id long, bar_start timestamp, interval_min int, open double, high double, low double, close double, volume double, source string, as_of_ts timestamp", ("instrument_id", "bar_start", "interval_min", "source"), "first"),
    "intraday_alerts": Table("position_id long, session_date date, state string, at timestamp", ("position_id", "session_date", "state"), "first"),
    "filings": Table("id long, source string, instrument_id long, title string, published_at timestamp, published_raw string, fetched_at timestamp, url string, full_text string, content_hash string, dedup_key string, processed boolean, attempts int", ("dedup_key",), "first"),
    "collector_health": Table("id int, last_success timestamp, last_error timestamp, message string", ("id",), "upsert"),
    "eval_labels": Table("filing_id long, label string, labelled_at timestamp", ("filing_id",), "upsert"),
    "eval_runs": Table("id long, at timestamp, config_hash string, metrics string", ("id",)),
}
