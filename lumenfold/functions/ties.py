"""Frequency ties: a component as an integer sum of stronger ones, as text and back."""

from __future__ import annotations

import re

_TERM = re.compile(r"([+-]?)\s*(\d*)\s*\*?\s*F(\d+)", re.I)


def parse_tie(text: str) -> dict[int, int]:
    """``2F1 - F3`` -> {1: 2, 3: -1}; repeated labels add up."""
    if _TERM.sub("", text).strip() or len(text) > 200:
        raise ValueError(f"not a sum of frequencies: {text!r}")
    out: dict[int, int] = {}
    for sign, number, label in _TERM.findall(text):
        out[int(label)] = out.get(int(label), 0) + (-1 if sign == "-" else 1) * int(number or 1)
    return {k: v for k, v in out.items() if v}


def format_tie(tie: dict[int, int]) -> str:
    """The text of a tie, parents in order."""
    parts = [("-" if v < 0 else "+") + (str(abs(v)) if abs(v) != 1 else "") + f"F{k}" for k, v in sorted(tie.items())]
    return " ".join(f"{p[0]} {p[1:]}" for p in parts).removeprefix("+ ").replace("- ", "-", 1) if parts and parts[0][0] == "-" else " ".join(f"{p[0]} {p[1:]}" for p in parts).removeprefix("+ ")
