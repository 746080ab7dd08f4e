"""Plan inspection."""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def operators(df: DataFrame) -> list[str]:
    """Names of the physical operators, in the order they are printed."""
    return re.findall(r"^[ +\-:*]*(?:\* )?([A-Z]\w+) \(\d+\)", plan_text(df), re.M)
