"""Column expressions on lines of text. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode's white space and the four separators; trimming by signs costs far less than a pattern.
SPACES = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
# What a contents leader, a trailing page reference, a step, a heading mark and a table
# separator look like.
LEADER = r"(?:[.·]\s?){4,}|(?:-\s){3,}"
PAGE_REF = r"\d+\s*[-–]\s*\d+\s*$"
STEP = r"(?i)^\s*(?:\d+[.)]\s+|step\s+\d+\b)"
ATX = r"^\s*#{1,6}\s+(.+?)\s*#*\s*$"
SEPARATOR = r"^:?-{2,}:?$"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends. A text between two printable ASCII signs is asked for these alone."""
    last = F.substring(c.cast("binary"), -1, 1)
    bare = F.ascii(c).between(33, 126) & last.between(F.lit(b"!"), F.lit(b"~"))
    return F.when(bare, c).otherwise(F.btrim(c, F.lit(SPACES)))


def lines(c: Column) -> Column:
    """The lines of a text, without a last empty one.

    The pieces are named once, since they would be computed anew wherever they stand; only texts with other ends than
    a line feed are cut by a pattern."""
    other = c.rlike(r"[\r\x0b\x0c\x1c\x1d\x1e\x85]") | c.contains("\u2028") | c.contains("\u2029")
    fed = F.when(other, F.regexp_replace(c, _LINE_END, "\n")).otherwise(c)
    without = lambda own: F.when(F.element_at(own, -1) == "", F.slice(own, 1, F.size(own) - 1)).otherwise(own)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.element_at(F.transform(F.array(F.split(fed, "\n", -1)), without), 1))


def cells(line: Column) -> Column:
    """A pipe row's stripped cells without one empty cell at either end."""
    all_cells = F.transform(F.split(line, "[|]", -1), strip)
    tail = F.when(F.element_at(all_cells, 1) == "", F.slice(all_cells, 2, F.size(all_cells))).otherwise(all_cells)
    return F.when((F.size(tail) > 0) & (F.try_element_at(tail, F.lit(-1)) == ""), F.slice(tail, 1, F.greatest(F.size(tail) - 1, F.lit(0)))).otherwise(tail)


def is_separator(row: Column) -> Column:
    """Whether every non-empty cell is dashes, or all are empty."""
    return F.forall(row, lambda c: (c == "") | c.rlike(SEPARATOR))


def heading(stripped: Column) -> Column:
    """The heading's text, or null if the line is none. What costs least and tells most is asked first."""
    marked = F.regexp_extract(stripped, ATX, 1)
    loud = (
        F.length(stripped).between(2, 60)
        & (stripped == F.upper(stripped))
        & stripped.rlike(r"\p{L}")
        & ~stripped.rlike(r"[.:,;]$")
        & ~stripped.rlike(LEADER)
        & ~_paged(stripped)
    )
    return F.when(stripped.startswith("#") & stripped.rlike(ATX), strip(marked)).when(loud, stripped)


def _paged(stripped: Column) -> Column:
    """Whether a stripped line ends in a page reference; one that ends in no digit doesn't."""
    return F.right(stripped, F.lit(1)).between("0", "9") & stripped.rlike(PAGE_REF)


def line_kind(line: Column, stripped: Column | None = None) -> Column:
    """blank, navigation, table, heading, step or paragraph: the first that fits, in this order. The stripped line is
    asked often, so whoever has it as a column of its own should give it."""
    s = strip(line) if stripped is None else stripped
    return (
        F.when(s == "", "blank")
        .when(_paged(s) & s.rlike(LEADER), "navigation")
        .when(line.contains("|") & (F.size(cells(line)) >= 2), "table")
        .when(heading(s).isNotNull(), "heading")
        .when(line.rlike(STEP), "step")
        .otherwise("paragraph")
    )


def normalized(line: Column) -> Column:
    """A running header's form: digits become #."""
    return strip(F.regexp_replace(line, r"\d+", "#"))
