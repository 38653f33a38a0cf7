"""Identifiers in text as column expressions: one literal pattern each, no join on patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.config import DEFAULT_CODE_PATTERNS, CodePattern

#: An identifier does not begin within a word or number.
GUARD = r"(?<![A-Za-z0-9])"


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _matches(text: Column, order: int, rule: CodePattern) -> Column:
    """(start, order, kind, value, raw) of a rule's matches; starts come from the pieces between them."""
    # looking at one character first leaves nearly every place at once
    ahead = f"(?=[{rule.first}])" if rule.first else ""
    pattern = "(?iU)" + ahead + GUARD + rule.regex.replace("(?P<id>", "(")

    def placed(whole: Column) -> Column:
        # one more piece than matches: the last has no match beside it
        pairs = F.zip_with(F.split(text, pattern, -1), whole, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("raw")))
        begun = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        step = lambda acc, x: F.struct((acc["at"] + x["gap"] + F.coalesce(F.length(x["raw"]), F.lit(0))).alias("at"), F.array_append(acc["starts"], acc["at"] + x["gap"]).alias("starts"))
        starts = F.aggregate(pairs, begun, step)["starts"]
        value = lambda m: F.concat(F.lit(rule.prefix + "-"), F.upper(F.regexp_extract(m, pattern, 1)))
        made = lambda s, m: F.struct(s.alias("start"), F.lit(order).alias("order"), F.lit(rule.name).alias("kind"), value(m).alias("value"), F.trim(m).alias("raw"))
        return F.zip_with(F.slice(starts, 1, F.size(whole)), whole, made)

    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # most texts have none, and are gone through once to see that
    none = F.array().cast("array<struct<start:int,order:int,kind:string,value:string,raw:string>>")
    return F.when(text.rlike(pattern), _let(whole, placed)).otherwise(none)


def extract(text: Column, rules: Sequence[CodePattern] = DEFAULT_CODE_PATTERNS) -> Column:
    """array<struct<kind,value,raw>>: of matches with one start the first rule's, of equal values the first."""
    text = F.coalesce(text, F.lit(""))
    found = F.array_sort(F.concat(*(_matches(text, k, r) for k, r in enumerate(rules))))
    claimed = _let(found, lambda all_: F.filter(all_, lambda x, i: (i == 0) | (F.try_element_at(all_, i)["start"] != x["start"])))
    once = _let(claimed, lambda own: _let(F.transform(own, lambda x: x["value"]), lambda values: F.filter(own, lambda x, i: F.array_position(values, x["value"]) == i + 1)))
    return F.transform(once, lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"), x["raw"].alias("raw")))
