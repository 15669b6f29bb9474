"""Traversal strings: V('x') and chained .Out('p'), .In('p'), .Both('p')."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from marlstone.operators.graph import Traversal, traverse

_ARG = r"\(\s*(?:'([^']*)'|\"([^\"]*)\")?\s*\)"
_START = re.compile(r"\s*(?:g\s*\.\s*)?V\s*" + _ARG, re.I)
_STEP = re.compile(r"\s*\.\s*(Out|In|Both)\s*" + _ARG, re.I)


def parse(query: str, most: int | None = None) -> tuple[str, list[tuple[str, str]]]:
    """Start node and steps. What follows the last known step is ignored; with ``most`` also further steps."""
    m = _START.match(query)
    if not m or not (node := m[1] or m[2]):
        raise ValueError("a query starts with V('node')")
    steps, at = [], m.end()
    while (most is None or len(steps) < most) and (m := _STEP.match(query, at)):
        steps.append((m[1].lower(), m[2] or m[3] or ""))
        at = m.end()
    return node, steps


def compile_query(quads: DataFrame, query: str, most: int | None = None) -> Traversal:
    node, steps = parse(query, most)
    t = traverse(quads).v(node)
    for kind, predicate in steps:
        t = {"out": t.out, "in": t.in_, "both": t.both}[kind](predicate)
    return t


def run(quads: DataFrame, query: str, most: int | None = 1) -> DataFrame:
    """Nodes that the query reaches; by default one step, as the REST call has it."""
    return compile_query(quads, query, most).values()
