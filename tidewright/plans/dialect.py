"""The dialect's forms and meanings that Spark SQL lacks, rewritten before Spark plans the text.

String literals are masked first, so nothing inside quotes is ever changed. Calls are rewritten by matching parentheses; PIVOT
becomes conditional aggregates, ASOF JOIN a frame of one struct per side, so that either side's columns keep their alias. The
text is analysed with ANSI errors off: arithmetic and casts that fail give null.
"""

from __future__ import annotations

import contextlib
import re
import uuid
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.joins import asof_join
from tidewright.operators.reshape import PIVOT_LIMIT

_LITERAL = re.compile(r"'(?:[^'\\]|\\.|'')*'")
_TOKEN = re.compile(r"\x00\d+\x00|`[^`]*`|\"[^\"]*\"|[A-Za-z_]\w*|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|<=>|<>|!=|>=|<=|\s+|.", re.S)
_MASK = re.compile(r"\x00(\d+)\x00")
_COMPARE = {"=", "<>", "!=", "<=>", "<", ">", "<=", ">="}
#: Aggregates whose window frame, if none is given, is the rows up to the current one.
_FRAMED = frozenset("sum try_sum avg min max count stddev_pop stddev_samp var_pop var_samp first last".split())


@contextlib.contextmanager
def soft(spark: SparkSession) -> Iterator[None]:
    """ANSI errors off for what is analysed inside; an expression keeps the mode that it was analysed in."""
    old = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)


def _closing(tokens: list[str], at: int) -> int:
    """The place of the parenthesis that closes the one at ``at``."""
    depth = 0
    for i in range(at, len(tokens)):
        depth += (tokens[i] == "(") - (tokens[i] == ")")
        if not depth:
            return i
    raise ValueError("a parenthesis is not closed")


def _opening(tokens: list[str], at: int) -> int:
    depth = 0
    for i in range(at, -1, -1):
        depth += (tokens[i] == ")") - (tokens[i] == "(")
        if not depth:
            return i
    raise ValueError("a parenthesis is not opened")


def _near(tokens: list[str], at: int, step: int = 1) -> int:
    """The next place, from ``at`` on, that isn't white space; -1 if there is none."""
    while 0 <= at < len(tokens):
        if not tokens[at].isspace():
            return at
        at += step
    return -1


def _split(tokens: list[str]) -> list[list[str]]:
    """At the commas outside parentheses."""
    out, depth = [[]], 0
    for t in tokens:
        depth += (t == "(") - (t == ")")
        if t == "," and not depth:
            out.append([])
        else:
            out[-1].append(t)
    return out if len(out) > 1 or "".join(out[0]).strip() else []


def _double(name: str) -> Callable[[list[str]], str]:
    return lambda a: f"CAST({name}({a[0]}) AS DOUBLE)" if len(a) == 1 else f"{name}({', '.join(a)})"


_CALLS: dict[str, Callable[[list[str]], str]] = {
    "stddev": lambda a: f"stddev_pop({a[0]})",
    "variance": lambda a: f"var_pop({a[0]})",
    "sum": lambda a: f"try_sum({a[0]})",
    "matches_regex": lambda a: f"regexp_like({', '.join(a)})",
    "percentile_cont": lambda a: f"percentile({', '.join(a)})" if len(a) == 2 else f"percentile_cont({', '.join(a)})",
    "substr": lambda a: f"substring({a[0]}, greatest({a[1]}, 1)" + "".join(f", greatest({x}, 0)" for x in a[2:]) + ")",
    "concat": lambda a: f"concat_ws('', {', '.join(a)})",
    "now": lambda a: "unix_micros(current_timestamp())",
    "floor": _double("floor"),
    "ceil": _double("ceil"),
    "round": _double("round"),
}
_CALLS["substring"] = _CALLS["substr"]


def _calls(tokens: list[str]) -> list[str]:
    """Calls by the dialect's meanings: population STDDEV and VARIANCE, SUM without overflow errors, a SUBSTR that starts at 1 at
    least, CONCAT with nulls as '', NOW() in microseconds, FLOOR, CEIL and ROUND as doubles."""
    out, i = [], 0
    while i < len(tokens):
        t = tokens[i]
        k = _near(tokens, i + 1)
        if t.lower() in _CALLS and k >= 0 and tokens[k] == "(" and (i == 0 or tokens[i - 1] != "."):
            end = _closing(tokens, k)
            args = ["".join(_calls(a)).strip() for a in _split(tokens[k + 1 : end])]
            out.append(_CALLS[t.lower()](args))
            i = end + 1
        else:
            out.append(t)
            i += 1
    return out


def _folded(tokens: list[str]) -> list[str]:
    """UPPER(x) or LOWER(x) compared with literals folds these as well."""
    out = list(tokens)

    def fold(name: str, at: int) -> None:
        if at >= 0 and _MASK.fullmatch(tokens[at]):
            out[at] = f"{name}({tokens[at]})"

    for i, t in enumerate(tokens):
        k = _near(tokens, i + 1)
        if t.lower() not in ("upper", "lower") or k < 0 or tokens[k] != "(":
            continue
        p = _near(tokens, i - 1, -1)
        if p >= 0 and tokens[p] in _COMPARE:
            fold(t, _near(tokens, p - 1, -1))
        n = _near(tokens, _closing(tokens, k) + 1)
        if n >= 0 and tokens[n].lower() == "not":
            n = _near(tokens, n + 1)
        if n < 0:
            continue
        after = _near(tokens, n + 1)
        if tokens[n] in _COMPARE or tokens[n].lower() == "like":
            fold(t, after)
        elif tokens[n].lower() == "in" and after >= 0 and tokens[after] == "(":
            for j in range(after, _closing(tokens, after)):
                fold(t, j)
    return out


def _frames(tokens: list[str]) -> list[str]:
    """An aggregate over a window without a frame takes the rows up to the current one, ordered or not."""
    out = list(tokens)
    for i, t in enumerate(tokens):
        k = _near(tokens, i + 1)
        if t.lower() != "over" or k < 0 or tokens[k] != "(":
            continue
        p = _near(tokens, i - 1, -1)
        f = _near(tokens, _opening(tokens, p) - 1, -1) if p >= 0 and tokens[p] == ")" else -1
        end = _closing(tokens, k)
        words = {w.lower() for w in tokens[k:end]}
        if f >= 0 and tokens[f].lower() in _FRAMED and not words & {"rows", "range"}:
            out[end] = ("" if "order" in words else " ORDER BY 0") + " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return out


def moment(text: str) -> datetime | None:
    """A time in UTC from RFC 3339, a date, or an epoch number by magnitude: below 1e11 s, 1e14 ms, 1e17 µs, else ns."""
    if re.fullmatch(r"\d+", text):
        n = int(text)
        micros = n * 10**6 if n < 10**11 else n * 1000 if n < 10**14 else n if n < 10**17 else n // 1000
        return datetime(1970, 1, 1) + timedelta(microseconds=micros)
    try:
        t = datetime.fromisoformat(text)
    except ValueError:
        return None
    return t.astimezone(UTC).replace(tzinfo=None) if t.tzinfo else t


def _times(tokens: list[str], literals: list[str], columns: set[str]) -> list[str]:
    """Literals that are compared with a time column become times."""
    out = list(tokens)

    def put(at: int) -> None:
        m = _MASK.fullmatch(tokens[at]) if at >= 0 else None
        plain = literals[int(m[1])][1:-1] if m else tokens[at] if at >= 0 and re.fullmatch(r"\d{9,}", tokens[at]) else ""
        if plain and (t := moment(plain)):
            out[at] = f"TIMESTAMP_NTZ '{t.isoformat(' ')}'"

    for i, t in enumerate(tokens):
        if t.strip('`"').lower() not in columns:
            continue
        n = _near(tokens, i + 1)
        if n >= 0 and tokens[n].lower() == "not":
            n = _near(tokens, n + 1)
        if n >= 0 and tokens[n] in _COMPARE:
            put(_near(tokens, n + 1))
        elif n >= 0 and tokens[n].lower() == "between":
            low = _near(tokens, n + 1)
            put(low)
            and_ = _near(tokens, low + 1)
            if and_ >= 0 and tokens[and_].lower() == "and":
                put(_near(tokens, and_ + 1))
        first = _near(tokens, i - 1, -1)
        while first >= 0 and tokens[first] == ".":  # an alias before the column
            first = _near(tokens, _near(tokens, first - 1, -1) - 1, -1)
        if first >= 0 and tokens[first] in _COMPARE:
            put(_near(tokens, first - 1, -1))
    return out


_AFTER = frozenset("where group order limit offset having union intersect except minus join inner left right full cross semi anti natural on using asof pivot unpivot window lateral tablesample match_condition cluster sort distribute".split())


def _renamed(tokens: list[str], names: dict[str, str]) -> list[str]:
    """Tables behind FROM and JOIN by the names of their views, under the alias that they had or their own name."""
    out = list(tokens)
    for i, t in enumerate(tokens):
        k = _near(tokens, i + 1)
        if t.lower() not in ("from", "join") or k < 0 or tokens[k] not in names:
            continue
        n = _near(tokens, k + 1)
        alias = n >= 0 and re.fullmatch(r"[A-Za-z_]\w*", tokens[n]) and tokens[n].lower() not in _AFTER
        out[k] = names[tokens[k]] + ("" if alias else f" AS {tokens[k]}")
    return out


def _source(tokens: list[str], at: int, step: int) -> tuple[int, str, str]:
    """A table or subquery with its alias, from ``at`` forwards or backwards: (place behind it, text, alias)."""
    word = lambda i: i >= 0 and re.fullmatch(r"[A-Za-z_]\w*", tokens[i])
    at = _near(tokens, at, step)
    if step > 0:
        end = _closing(tokens, at) if tokens[at] == "(" else at
        text, nxt = "".join(tokens[at : end + 1]), _near(tokens, end + 1)
        if nxt >= 0 and tokens[nxt].lower() == "as":
            nxt = _near(tokens, nxt + 1)
        if word(nxt) and tokens[nxt].lower() not in _AFTER:
            return nxt + 1, text, tokens[nxt]
        return end + 1, text, text if word(at) else "_source"
    alias = None
    before = _near(tokens, at - 1, -1)
    if word(at) and before >= 0 and tokens[before].lower() != "from":
        alias = tokens[at]
        at = _near(tokens, before - 1, -1) if tokens[before].lower() == "as" else before
    start = _opening(tokens, at) if tokens[at] == ")" else at
    text = "".join(tokens[start : at + 1])
    return start, text, alias or (text if word(at) else "_source")


def _find(tokens: list[str], *words: str) -> int:
    """The place of the first word of a phrase, -1 if it isn't there."""
    for i, t in enumerate(tokens):
        j = i
        for w in words:
            if j < 0 or j >= len(tokens) or tokens[j].lower() != w:
                break
            j = _near(tokens, j + 1)
        else:
            return i
    return -1


def _pivoted(spark: SparkSession, text: str, literals: list[str], most: int) -> str:
    """FROM source PIVOT (aggregates FOR column IN (values or ANY)) as conditional aggregates by all other columns. Groups whose
    rows fall outside the values stay; a missing bucket is the empty aggregate: COUNT 0, others null."""
    while (p := _find(tokens := _TOKEN.findall(text), "pivot", "(")) >= 0:
        start, source, _ = _source(tokens, p - 1, -1)
        k = _near(tokens, p + 1)
        end = _closing(tokens, k)
        inner = tokens[k + 1 : end]
        depth, cut = 0, -1
        for i, t in enumerate(inner):
            depth += (t == "(") - (t == ")")
            if t.lower() == "for" and not depth:
                cut = i
        on = inner[_near(inner, cut + 1)]
        listed = inner[_near(inner, _find(inner, "in") + 1) :]
        items = _split(listed[1 : _closing(listed, 0)])
        name = on.strip('`"')
        frame = spark.sql(_unmasked(f"SELECT * FROM {source}", literals))
        if len(items) == 1 and "".join(items[0]).strip().lower() == "any":
            found = [r[0] for r in frame.select(name).dropna().distinct().limit(most + 1).collect()]  # at most ``most`` and one
            values = [("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else str(v), str(v)) for v in sorted(found)]
        else:
            values = []
            for item in items:
                lit = item[_near(item, 0)] if item[_near(item, 0)] != "-" else "".join(item).split()[0]
                plain = _unmasked(lit, literals)
                values.append((plain, plain[1:-1] if plain.startswith("'") else plain))
        if len(values) > most:
            raise ValueError(f"a pivot over more than {most} values")
        measures, used = [], {name.lower()}
        for m in _split(inner[:cut]):
            m = m[_near(m, 0) :]
            open_ = _near(m, 1)
            shut = _closing(m, open_)
            args = _split(m[open_ + 1 : shut])
            used |= {t.strip('`"').lower() for a in args for t in a}
            alias = [t for t in m[shut + 1 :] if re.fullmatch(r"`.*`|\w+", t) and t.lower() != "as"]
            measures.append((m[0], ["".join(a).strip() for a in args], alias[-1].strip("`") if alias else f"{m[0]}_{''.join(args[0]).strip()}"))
        anchors = [f"`{c}`" for c in frame.columns if c.lower() not in used]
        out = list(anchors)
        for literal, plain in values:
            for fn, args, alias in measures:
                distinct, arg = ("DISTINCT ", args[0][9:]) if args[0].lower().startswith("distinct ") else ("", args[0])
                case = f"CASE WHEN {on} = {literal} THEN {'1' if arg == '*' else arg} END"
                column = plain if len(measures) == 1 else f"{plain}_{alias}"
                out.append(f"{fn}({', '.join([distinct + case, *args[1:]])}) AS `{column}`")
        body = f"(SELECT {', '.join(out or ['1 AS nothing'])} FROM {source}{'' if values else ' WHERE false'}" + (f" GROUP BY {', '.join(anchors)})" if anchors else ")")
        text = "".join(tokens[:start]) + body + "".join(tokens[end + 1 :])
    return text


def _asof(spark: SparkSession, text: str, literals: list[str]) -> str:
    """left ASOF JOIN right MATCH_CONDITION (l.t >= r.t) USING (keys): each left row with the last right row of its keys not after it."""
    while (j := _find(tokens := _TOKEN.findall(text), "asof", "join")) >= 0:
        start, left, a = _source(tokens, j - 1, -1)
        at, right, b = _source(tokens, _near(tokens, j + 1) + 1, 1)
        m = re.match(r"\s*match_condition\s*\(\s*(?:(\w+)\s*\.\s*)?(\w+)\s*(>=|<=)\s*(?:(\w+)\s*\.\s*)?(\w+)\s*\)\s*using\s*\(([^)]*)\)", "".join(tokens[at:]), re.I)
        if not m:
            raise ValueError("ASOF JOIN takes MATCH_CONDITION (left.time >= right.time) USING (keys)")
        lt, rt = (m[2], m[5]) if m[3] == ">=" else (m[5], m[2])
        keys = [k.strip() for k in m[6].split(",")]
        frames = [spark.sql(_unmasked(f"SELECT * FROM {s}", literals)) for s in (left, right)]
        sides = [f.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(t).alias("_at"), F.struct("*").alias(n)) for f, t, n in zip(frames, (lt, rt), ("_a", "_b"), strict=True)]
        joined = asof_join(*sides, [f"_k{i}" for i in range(len(keys))], "_at")
        own, other = (f.columns for f in frames)
        bare = {c: F.col("_a")[c] for c in own} | {c: F.col("_b")[c] for c in other if c not in own} | {f"right_{c}": F.col("_b")[c] for c in other if c in own and c not in keys}
        second = F.struct(F.col("_b.*"), *[F.col("_b")[c].alias(f"right_{c}") for c in other if c in own and c not in keys])
        view = f"asof_{uuid.uuid4().hex[:8]}"
        joined.select(F.col("_a").alias(a), second.alias(b), *[c.alias(n) for n, c in bare.items() if n not in (a, b)]).createOrReplaceTempView(view)
        head = "".join(tokens[:start])
        star = ", ".join([f"{a}.*", *(f"{b}.`{c}`" + (f" AS `right_{c}`" if c in own else "") for c in other if c not in keys)])
        head = re.sub(r"(\bselect\s+(?:distinct\s+)?)\*(\s*from\s*)$", lambda x: x[1] + star + x[2], head, flags=re.I)
        text = f"{head}{view} {''.join(tokens[at:])[m.end() :]}"
    return text


def _unmasked(text: str, literals: list[str]) -> str:
    return _MASK.sub(lambda m: literals[int(m[1])], text)


def rewrite(spark: SparkSession, text: str, pivot_values: int = PIVOT_LIMIT, times: set[str] | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """Plans dialect SQL.

    Topic names may begin with a slash; STDDEV and VARIANCE are population ones; MATCHES_REGEX searches anywhere;
    PERCENTILE_CONT(column, q); LIMIT offset, n; PIVOT with COUNT 0 and IN (ANY); a ASOF JOIN b MATCH_CONDITION (a.ts >= b.ts)
    USING (k); soft nulls; literals folded beside UPPER and LOWER; windows by ROWS. ``times``: names of time columns; ``names``: views of topics that are not named like them.
    """
    literals: list[str] = []

    def mask(m: re.Match) -> str:
        literals.append(m[0])
        return f"\x00{len(literals) - 1}\x00"

    text = _LITERAL.sub(mask, text)
    text = re.sub(r"\b(from|join)\s+/([\w/-]+)", lambda m: f"{m[1]} {m[2].replace('-', '_').replace('/', '_')}", text, flags=re.I)
    text = re.sub(r"\blimit\s+(\d+)\s*,\s*(\d+)", r"limit \2 offset \1", text, flags=re.I)
    tokens = _folded(_renamed(_TOKEN.findall(text), names or {}))
    if times:
        tokens = _times(tokens, literals, {c.lower() for c in times})
    text = "".join(_frames(_TOKEN.findall("".join(_calls(_TOKEN.findall("".join(tokens)))))))
    with soft(spark):
        text = _asof(spark, _pivoted(spark, text, literals, pivot_values), literals)
        return spark.sql(_unmasked(text, literals))
