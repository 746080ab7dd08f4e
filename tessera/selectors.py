"""Column selectors: name, 1-based position, list, bool mask, regex, Not, Between, Cols, All."""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Not:
    inner: object


@dataclass(frozen=True)
class Between:
    first: object
    last: object


class Cols:
    def __init__(self, *parts):
        self.parts = parts


class All:
    pass


def resolve(columns: list[str], sel) -> list[str]:
    """Names that a selector picks, in its order; duplicates and unknown names are errors."""
    if sel is None or isinstance(sel, All) or sel == ":":
        return list(columns)
    if isinstance(sel, bool):
        raise TypeError("a bool is not a column")
    if isinstance(sel, int):
        if not 1 <= sel <= len(columns):
            raise IndexError(f"no column {sel} among {len(columns)}")
        return [columns[sel - 1]]
    if isinstance(sel, str):
        if sel not in columns:
            near = difflib.get_close_matches(sel, columns, 3)
            raise KeyError(f"no column {sel!r}" + (f"; did you mean {', '.join(near)}?" if near else ""))
        return [sel]
    if isinstance(sel, re.Pattern):
        return [c for c in columns if sel.search(c)]
    if isinstance(sel, Not):
        gone = set(resolve(columns, sel.inner))
        return [c for c in columns if c not in gone]
    if isinstance(sel, Between):
        a, b = (columns.index(resolve(columns, x)[0]) for x in (sel.first, sel.last))
        return columns[a : b + 1]
    if isinstance(sel, Cols):
        return list(dict.fromkeys(c for p in sel.parts for c in resolve(columns, p)))
    if isinstance(sel, (list, tuple)):
        if sel and all(isinstance(x, bool) for x in sel):
            if len(sel) != len(columns):
                raise ValueError("a mask needs one bool for each column")
            return [c for c, keep in zip(columns, sel, strict=True) if keep]
        out = [c for x in sel for c in resolve(columns, x)]
        if len(set(out)) < len(out):
            raise ValueError("a column is selected twice")
        return out
    raise TypeError(f"not a selector: {sel!r}")


def make_unique(names: list[str], taken: list[str] = (), allow: bool = True) -> list[str]:
    """Names with _1, _2, ... where they clash."""
    used, out = set(taken), []
    for n in names:
        k, new = 0, n
        while new in used:
            if not allow:
                raise ValueError(f"duplicate column {n!r}")
            k += 1
            new = f"{n}_{k}"
        used.add(new)
        out.append(new)
    return out
