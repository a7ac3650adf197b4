"""All SQL texts by query name."""

from __future__ import annotations


def sql_texts() -> dict[str, str]:
    from oracle import care, reports

    out: dict[str, str] = {}
    for module in (reports, care):
        overlap = set(out) & set(module.SQL)
        if overlap:
            raise ValueError(f"defined twice: {overlap}")
        out.update(module.SQL)
    return out
