"""Rules as data, compiled to column expressions.

A log filter is a set of patterns with one ``<HOST>`` each; an ordered rule list is a chain of
conditions where the first hit decides. Both become one projection: no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailfleet.functions.scalars import LOG_TIME_FORMATS, ColumnOrName, col

HOST = "<HOST>"
# A whole address or name: it does not begin inside another word.
_HOST_GROUP = r"(?<![0-9A-Za-z_.:\-])([0-9A-Za-z_.:\-]*[0-9A-Za-z_])"


@dataclass(frozen=True)
class LogFilter:
    """Patterns of one jail. ``time`` finds the clock text, which is cut out before matching."""

    jail: str
    kind: str
    time: str
    fail: tuple[str, ...]
    ignore: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.kind not in LOG_TIME_FORMATS:
            raise ValueError(f"{self.jail}: unknown time format {self.kind!r}")
        if not self.fail:
            raise ValueError(f"{self.jail}: no failure pattern")
        for pattern in (*self.fail, *self.ignore):
            if pattern.count(HOST) != 1:
                raise ValueError(f"{self.jail}: exactly one {HOST} per pattern: {pattern}")


def _regex(pattern: str) -> str:
    return pattern.replace(HOST, _HOST_GROUP)


def _any_of(patterns: Sequence[str]) -> str:
    return "|".join(f"(?:{_regex(p)})" for p in patterns)


# The failure lines each service writes, after its clock text is cut out.
FILTERS = (
    LogFilter(
        jail="admin",
        kind="access",
        time=r"[0-9]{2}/[A-Z][a-z]{2}/[0-9]{4}:[0-9]{2}:[0-9]{2}:[0-9]{2} [+-][0-9]{4}",
        fail=(
            r'^<HOST> - \S+ \[\] "POST /login\.php[^"]*" 200 ',
            r'^<HOST> - \S+ \[\] "POST /users/password-recover\.php[^"]*" 200 ',
        ),
        ignore=(r'^<HOST> - \S+ \[\] "POST /login\.php[^"]*" 30[0-9] ',),
    ),
    LogFilter(
        jail="webmail",
        kind="webmail",
        time=r"[0-9]{2}-[A-Z][a-z]{2}-[0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2} [+-][0-9]{4}",
        fail=(
            r"^\[\]:\s+(?:<\S+>\s+)?IMAP Error: Login failed for \S+ (?:against \S+ )?from <HOST>",
            r"^\[\]:\s+(?:<\S+>\s+)?Failed login for \S+ from <HOST>",
            r"^\[\]:\s+(?:<\S+>\s+)?Error: Login failed for \S+ from <HOST>",
        ),
        ignore=(r"^\[\]:\s+(?:<\S+>\s+)?Successful login for \S+ from <HOST>",),
    ),
    LogFilter(
        jail="imap-ext",
        kind="imap",
        time=r"[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}",
        fail=(
            r"^\s*(?:auth|imap-login|managesieve-login): (?:Info|Warning): .*"
            r"(?:authentication failure|Aborted login|Disconnected \(auth failed).*rip=<HOST>",
            r"^\s*doveadm: Error: .*[Aa]uthentication failed.* rip=<HOST>",
            r"^\s*doveadm.*: Error: doveadm client:.*: Authentication failed.*<HOST>",
            r"^\s*(?:auth|imap-login): Info: Login aborted.*rip=<HOST>",
        ),
    ),
)


def filter_named(jail: str) -> LogFilter:
    return next(f for f in FILTERS if f.jail == jail)


@dataclass(frozen=True)
class CompiledFilter:
    ts: Column
    shape: Column
    ip: Column
    is_failure: Column


def compile_filter(rule: LogFilter, line: ColumnOrName = "line") -> CompiledFilter:
    """Columns of a filter: event time, matching failure pattern (1-based), source, verdict."""
    clock = F.regexp_extract(col(line), f"({rule.time})", 1)
    text = F.regexp_replace(col(line), rule.time, "")
    patterns = [_regex(p) for p in rule.fail]
    hits = [text.rlike(p) for p in patterns]
    shape = F.coalesce(*[F.when(h, F.lit(i)) for i, h in enumerate(hits, 1)])
    ip = F.coalesce(*[F.when(h, F.regexp_extract(text, p, 1)) for h, p in zip(hits, patterns)])
    # One alternation decides whether a line fails; shape and source matter for failures only.
    failing = text.rlike(_any_of(rule.fail))
    if rule.ignore:
        failing = failing & ~text.rlike(_any_of(rule.ignore))
    return CompiledFilter(
        ts=F.try_to_timestamp(clock, F.lit(LOG_TIME_FORMATS[rule.kind])),
        shape=shape,
        ip=ip,
        is_failure=failing,
    )


def compile_filters(
    rules: Sequence[LogFilter] = FILTERS, line: ColumnOrName = "line"
) -> dict[str, CompiledFilter]:
    return {rule.jail: compile_filter(rule, line) for rule in rules}


def first_match(rules: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """Ordered rules as one expression: the value of the first condition that holds."""
    chain = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    if chain is None:
        raise ValueError("no rules")
    return chain.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def findings(rules: Sequence[tuple[Column, object]]) -> Column:
    """All rules that hold, in rule order, as an array."""
    cells = [F.when(c, v if isinstance(v, Column) else F.lit(v)) for c, v in rules]
    return F.filter(F.array(*cells), lambda x: x.isNotNull())
