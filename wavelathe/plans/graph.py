"""Pipelines from a dict: nodes are operators, edges are named levels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..metadata import carried

#: Nodes that give each field as many elements as they take, in place: names and axes hold behind them.
IN_PLACE = {"filter", "join", "segment", "in_turns", "vector", "vector_preemphasis", "window", "power_db", "a_weight"}
OPERATORS: dict[str, Callable[..., DataFrame]] = {}


def operator(name: str):
    """Register a function (levels..., **options) -> DataFrame under a type name."""

    def add(fn):
        OPERATORS[name] = fn
        return fn

    return add


def build(spec: list[dict], levels: dict[str, DataFrame], **shared) -> dict[str, DataFrame]:
    """Run the spec's nodes {type, reads, writes, options} in the order that their levels allow; one writer a level.

    Options given here too, such as keys, hold for all nodes that don't set them.
    Names and axes of array fields (see `metadata`) go along behind nodes that
    keep a field's elements, and are set by those that make spectra and bands.
    """
    from . import nodes  # noqa: F401  registers the library's own

    levels, left = dict(levels), list(spec)
    while left:
        ready = [n for n in left if all(r in levels for r in n.get("reads", []))]
        if not ready:
            raise ValueError(f"levels without a writer: {sorted({r for n in left for r in n.get('reads', []) if r not in levels})}")
        for n in ready:
            if n["writes"] in levels:
                raise ValueError(f"level {n['writes']} has two writers")
            if n["type"] not in OPERATORS:
                raise ValueError(f"no operator {n['type']}")
            read = [levels[r] for r in n.get("reads", [])]
            out = OPERATORS[n["type"]](*read, **{**shared, **n.get("options", {})})
            levels[n["writes"]] = carried(out, *read) if n["type"] in IN_PLACE and isinstance(out, DataFrame) else out
            left.remove(n)
    return levels

