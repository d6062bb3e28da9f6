"""Limits on queries and views: structure before planning, size before running, rows while running."""

from __future__ import annotations

import contextlib
import io
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class GuardrailError(ValueError):
    pass


@dataclass
class Limits:
    """0 switches a limit off."""

    pivot_values: int = 100
    view_depth: int = 3
    max_rows: int = 0
    max_bytes: int = 0

    def tighter(self, other: Limits) -> Limits:
        pick = lambda a, b: min(x for x in (a, b) if x) if a or b else 0
        return Limits(pick(self.pivot_values, other.pivot_values), pick(self.view_depth, other.view_depth), pick(self.max_rows, other.max_rows), pick(self.max_bytes, other.max_bytes))


def check_view(view, topics: dict, views: dict, depth: int = 3) -> None:
    """Views aggregate, do not group by the exact key of their source, form no cycle and no chain above ``depth``."""
    text = view.sql
    group = re.search(r"\bgroup\s+by\s+(.+?)(\bhaving\b|\border\b|\blimit\b|$)", text, re.I | re.S)
    if not group and not re.search(r"\b(count|sum|avg|min|max|stddev\w*|var\w*|median|percentile\w*)\s*\(", text, re.I):
        raise GuardrailError(f"view {view.name} has no aggregate")
    if group:
        cols = {c.strip().strip("`") for c in group[1].split(",")}
        for s in view.sources:
            if s in topics and topics[s].keys and cols == set(topics[s].keys):
                raise GuardrailError(f"view {view.name} groups by the exact key of {s}")

    def level(name: str, seen: tuple[str, ...]) -> int:
        if name in seen:
            raise GuardrailError(f"view {name} depends on itself")
        v = view if name == view.name else views.get(name)
        return 1 + max([0, *(level(s, (*seen, name)) for s in v.sources)]) if v else 0

    if level(view.name, ()) > depth:
        raise GuardrailError(f"view {view.name} is more than {depth} levels above its topics")


def estimate(df: DataFrame) -> dict[str, int]:
    """Catalyst's size and, if it knows it, row estimate of the whole plan, from EXPLAIN COST."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode="cost")
    text = out.getvalue().partition("Optimized Logical Plan")[2]
    units = {"B": 1, "KiB": 2**10, "MiB": 2**20, "GiB": 2**30, "TiB": 2**40, "PiB": 2**50, "EiB": 2**60}
    first = re.search(r"Statistics\(([^)]*)\)", text)
    size, rows = (re.search(x, first[1] if first else "") for x in (r"sizeInBytes=([\d.E+]+) (\w+)", r"rowCount=([\d.E+]+)"))
    return {"bytes": int(float(size[1]) * units.get(size[2], 1)) if size else 0} | ({"rows": int(float(rows[1]))} if rows else {})


def preflight(df: DataFrame, limits: Limits) -> DataFrame:
    """Refuses a plan whose estimate is over the limits. Rows are only known where Catalyst knows them; else ``capped`` counts."""
    if not limits.max_bytes and not limits.max_rows:
        return df
    e = estimate(df)
    if limits.max_bytes and e["bytes"] > limits.max_bytes:
        raise GuardrailError(f"estimated {e['bytes']} bytes; the limit is {limits.max_bytes}")
    if limits.max_rows and e.get("rows", 0) > limits.max_rows:
        raise GuardrailError(f"estimated {e['rows']} rows; the limit is {limits.max_rows}")
    return df


def capped(df: DataFrame, max_rows: int) -> DataFrame:
    """The frame, which fails when it is run and has more than ``max_rows`` rows: never a silently cut result. The limit makes one
    partition, so the rows' numbers are exact; the query runs once."""
    number = F.monotonically_increasing_id()
    return df.limit(max_rows + 1).filter(F.when(number >= max_rows, F.raise_error(F.lit(f"more than {max_rows} rows")).cast("boolean")).otherwise(True))


def active_set(df: DataFrame, most: int) -> int:
    """Rows that a subscription holds; more than ``most`` closes it (0: no limit). Counts ``most`` and one at most."""
    n = df.limit(most + 1).count() if most else df.count()
    if most and n > most:
        raise GuardrailError(f"too many matches: more than {most}")
    return n


def interval_ms(asked: int | None, baseline: int, most: int = 60_000) -> int:
    """The conflation interval: what the subscriber asks for, else the topic's; 0 means none; a minute at most."""
    return min(max(baseline if asked is None else asked, 0), most)
