"""The template language of workflow inputs: nested references, conditionals, escapes.

The grammar nests, so it is one small function over a row's template and values,
applied in Arrow batches; flat references are resolved by joins instead
(operators.workflow.resolved_references).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARISON = re.compile(r"^\s*(\S+)\s*(==|!=|<=|>=|<|>)\s*\"([^\"]*)\"\s*\?(.*)$", re.DOTALL)
_EXISTS = re.compile(r"^\s*(\S+)\s*\?(.*)$", re.DOTALL)
_TESTS = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def _split(text: str, separator: str) -> tuple[str, str]:
    """The text before and after the first separator outside `${...}`."""
    depth = 0
    for i, c in enumerate(text):
        depth += text.startswith("${", i)
        if c == "}" and depth:
            depth -= 1
        elif c == separator and not depth:
            return text[:i], text[i + 1 :]
    return text, ""


def render(template: str, values: dict[str, str]) -> str | None:
    """A template with its `${...}` replaced; null if a reference has no value.

    `\\${` is a plain `${`.  `a == "x" ? p : q` compares strings; `a ? p | q` asks
    whether a has a value that isn't empty.  Either side may hold templates.
    """
    out, i = [], 0
    while i < len(template):
        if template.startswith("\\${", i):
            out.append("${")
            i += 3
        elif template.startswith("${", i):
            depth, j = 1, i + 2
            while j < len(template) and depth:
                depth += template.startswith("${", j)
                depth -= template[j] == "}"
                j += 1
            if depth:
                return None
            value = _expression(template[i + 2 : j - 1], values)
            if value is None:
                return None
            out.append(value)
            i = j
        else:
            out.append(template[i])
            i += 1
    return "".join(out)


def _expression(text: str, values: dict[str, str]) -> str | None:
    if found := _COMPARISON.match(text):
        name, test, literal, rest = found.groups()
        yes, no = _split(rest, ":")
        return render((yes if _TESTS[test](values.get(name, ""), literal) else no).strip(), values)
    if (found := _EXISTS.match(text)) and "?" in text:
        yes, no = _split(found[2], "|")
        return render((yes if values.get(found[1]) else no).strip(), values)
    return values.get(text.strip())


def rendered(template: Column, values: Column) -> Column:
    """Templates rendered with a map of values."""

    @F.pandas_udf("string")
    def apply(templates: pd.Series, maps: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else render(t, dict(m or {})) for t, m in zip(templates, maps, strict=True)])

    return apply(template, values)


def command_parts(parts: Column, lists: Column) -> Column:
    """Command parts with `*name` replaced by the list of that name (JSON), without empty ones and `''`."""
    one = lambda p: F.when(p.startswith("*"), F.coalesce(F.from_json(lists[F.substr(p, F.lit(2))], "array<string>"), F.array().cast("array<string>"))).otherwise(F.array(p))
    return F.filter(F.flatten(F.transform(parts, one)), lambda p: ~p.isin("", "''"))
