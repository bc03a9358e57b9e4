"""Name helpers."""

from __future__ import annotations

import re


def scrub(text: str) -> str:
    """Field-safe name for an account (X9): blanks and dashes to ``_``, lower case."""
    return re.sub(r"[ -]", "_", text).lower()


def adjustment_column(account: str) -> str:
    return "adj_" + scrub(account)
