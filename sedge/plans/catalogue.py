"""All queries and their SQL."""

from __future__ import annotations

from sedge.plans import more, proofs, selection, sources, stats, tables, uncertainty, workflows

PARTS = (uncertainty, stats, tables, selection, workflows, more, sources, proofs)


def merged(tables: list[dict]) -> dict:
    """All entries of the tables, of which no two may have one name."""
    out: dict = {}
    for t in tables:
        if twice := out.keys() & t.keys():
            raise ValueError(f"there twice: {', '.join(sorted(twice))}")
        out |= t
    return out


QUERIES = merged([part.QUERIES for part in PARTS])
ORACLE_SQL = merged([part.ORACLE_SQL for part in PARTS])
