"""Structured Streaming form of the ledger summary."""

from tally.streaming.ledger_stream import read_entries, running_balances, start

__all__ = ["read_entries", "running_balances", "start"]
