"""Puts a final SELECT behind the named relations it mentions."""

from __future__ import annotations

import re


def with_relations(select: str, relations: dict[str, str]) -> str:
    ordered: list[str] = []

    def visit(text: str, trail: tuple[str, ...]) -> None:
        words = set(re.findall(r"\b(?:FROM|JOIN)\s+([a-z_0-9]+)", text))
        for name in relations:
            if name in words and name not in trail and name not in ordered:
                visit(relations[name], (*trail, name))
                ordered.append(name)

    visit(select, ())
    if not ordered:
        return select.strip()
    body = ",\n".join(f"{n} AS ({relations[n].strip()})" for n in ordered)
    return f"WITH {body}\n{select.strip()}"


def rounded(x: str, digits: int) -> str:
    """Half away from zero on the decimal digits (DuckDB's round scales in binary)."""
    return f"CAST(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,{digits})) AS DOUBLE)"


def decimal2(x: str) -> str:
    return f"CAST(CAST({x} AS VARCHAR) AS DECIMAL(18,2))"


def whole(x: str) -> str:
    return f"CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,0))"
