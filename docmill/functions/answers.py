"""Column expressions on model replies: markers, cited passages, the not-found reply, structured replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.config import NOT_FOUND
from docmill.functions.text import lines, strip

# Passage ids as a model cites them, and bracketed groups of them.
ID_TOKEN = r"(?<![0-9a-fA-F])([0-9a-f]{6,32})(?![0-9a-fA-F])"
GROUP = r"\s*\[[0-9a-f][0-9a-f,;\s]*\]"
FENCE = r"(?i)^\s*```(?:json)?\s*|\s*```\s*$"
ENUMERATOR = r"^\s*(?:\d+[.)]|[-*•])\s+"
SLACK = 30
FALLBACK = 3
#: JSON values that count as not found.
FALSY = ("null", "false", '""', "[]", "{}")


def strip_markers(c: Column) -> Column:
    """Without bracketed citations and the spaces they leave."""
    c = F.regexp_replace(c, GROUP, "")
    c = F.regexp_replace(c, r"[ \t]{2,}", " ")
    return strip(F.regexp_replace(c, r" +\n", "\n"))


def clean_answer(c: Column, drop: str = NOT_FOUND) -> Column:
    """Without markers and lines that hold only the not-found sentence."""
    kept = F.filter(lines(strip_markers(c)), lambda x: strip(x) != drop.strip())
    return strip(F.array_join(kept, "\n"))


def is_not_found(c: Column) -> Column:
    """Whether the reply is the not-found sentence, with at most a short lead-in. An empty reply is not."""
    core = strip(F.regexp_replace(F.lower(strip_markers(c)), r"[.!]+$", ""))
    target = NOT_FOUND.lower().rstrip(".")
    return (core == target) | (core.contains(target) & (F.length(core) <= len(target) + SLACK))


def cited_ids(reply: Column, offered: Column) -> Column:
    """Offered passage ids that the reply names, in order, once each."""
    return F.array_intersect(F.regexp_extract_all(reply, F.lit(ID_TOKEN), F.lit(1)), offered)


def cited_or_first(reply: Column, offered: Column) -> Column:
    """The cited ids, or without any the first few offered."""
    cited = cited_ids(reply, offered)
    return F.when(F.size(cited) > 0, cited).otherwise(F.slice(F.array_distinct(offered), 1, FALLBACK))


def clean_step(c: Column) -> Column:
    return strip(F.regexp_replace(strip(c), ENUMERATOR, ""))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _object(c: Column) -> Column:
    """The variant of a text that is one JSON object and nothing else, else null."""
    # within brackets, text beyond the object is an error or a second element
    alone = lambda v: F.when(F.try_variant_get(v, "$[1]", "variant").isNull(), F.try_variant_get(v, "$[0]", "variant"))
    return F.when(c.startswith("{"), _let(F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), alone))


def _spoken(v: Column) -> Column:
    """A list's element as text."""
    kind = F.schema_of_variant(v)
    return F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind == "BOOLEAN", F.initcap(F.to_json(v))).when(kind == "VOID", "None").otherwise(F.to_json(v))


def _fields(got: Column, offered: Column) -> Column:
    found = F.to_json(F.try_variant_get(got, "$.found", "variant"))
    no = found.isin(*FALSY) | F.coalesce(found.try_cast("double") == 0, F.lit(False))
    listed = lambda name: F.coalesce(F.try_variant_get(got, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))
    steps = F.filter(F.transform(listed("steps"), lambda s: clean_step(_spoken(s))), lambda s: s != "")
    texts = F.filter(listed("used"), lambda u: F.schema_of_variant(u) == "STRING")
    used = F.filter(F.transform(texts, lambda u: F.regexp_replace(strip(F.try_variant_get(u, "$", "string")), r"^[\[\]]+|[\[\]]+$", "")), lambda u: F.array_contains(offered, u))
    answer = F.when(F.schema_of_variant(F.try_variant_get(got, "$.answer", "variant")) == "STRING", strip(F.try_variant_get(got, "$.answer", "string")))
    return F.struct((~F.coalesce(no, F.lit(False))).alias("found"), F.coalesce(answer, F.lit("")).alias("answer"), steps.alias("steps"), used.alias("used"))


def parse_structured(reply: Column, offered: Column) -> Column:
    """struct<found,answer,steps,used> of a JSON reply, fenced or within prose; null if there is none.

    A value of ``found`` counts as it does in a condition, and a missing one as true; an answer that is no
    text is empty; steps that are no text are written out; ``used`` keeps offered ids that are texts, each
    as often as it is named.
    """
    bare = strip(F.regexp_replace(reply, FENCE, ""))
    got = _let(bare, lambda b: F.coalesce(_object(b), _object(F.regexp_extract(b, r"(?s)\{.*\}", 0))))
    return _let(got, lambda v: F.when(v.isNotNull(), _fields(v, offered)))


def render_structured(answer: Column, steps: Column) -> Column:
    """The answer's line, then steps numbered from 1."""
    numbered = F.transform(steps, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s))
    return F.array_join(F.concat(F.when(answer != "", F.array(answer)).otherwise(F.array().cast("array<string>")), numbered), "\n")


def clean_captions(reply: Column) -> Column:
    """Lines of a vision reply without bullets, one-digit numbers, blanks and NONE."""
    bare = F.transform(lines(reply), lambda x: strip(F.regexp_replace(F.regexp_replace(strip(x), r"^[-*]+\s*", ""), r"^\d[.)]\s*", "")))
    return F.filter(bare, lambda x: (x != "") & (F.upper(x) != "NONE"))
