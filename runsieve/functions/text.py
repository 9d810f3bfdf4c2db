"""Text columns: truthiness defaults, Unicode stripping, token sets.

Functions ending in ``_sql`` return Spark SQL text over expression text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when text is stripped
# (Unicode white space plus the four ASCII separators).
_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0            "
    "    　"
)
_SPLIT = r"(?U)[\s\x1c-\x1f]+"
_ALNUM = "[a-z0-9]+"


def or_str(*cols: Column) -> Column:
    """First value that is neither NULL nor the empty string (blanks do count)."""
    return F.coalesce(*[F.when(c != "", c) for c in cols])


def or_arr(*cols: Column) -> Column:
    """First array that is neither NULL nor empty, else NULL."""
    return F.coalesce(*[F.when(F.size(c) > 0, c) for c in cols])


def n_items(arr: Column) -> Column:
    """Array length with NULL counted as 0."""
    return F.coalesce(F.size(arr), F.lit(0))


def strip(col: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(col, F.lit(_SPACES))


def strip_sql(x: str) -> str:
    return f"btrim({x}, '{''.join(f'\\u{ord(c):04x}' for c in _SPACES)}')"


def stripped_names_sql(arr: str) -> str:
    """Strip each name and drop blanks; order and repeats are kept."""
    return f"filter(transform({arr}, x -> {strip_sql('x')}), x -> x <> '')"


def ws_tokens(col: Column) -> Column:
    """Distinct whitespace-separated tokens of the lowercased text."""
    return F.array_remove(F.array_distinct(F.split(F.lower(col), _SPLIT)), "")


def ws_tokens_sql(x: str) -> str:
    return f"array_remove(array_distinct(split(lower({x}), r'{_SPLIT}')), '')"


def alnum_tokens(col: Column) -> Column:
    """Distinct runs of ASCII letters and digits in the lowercased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(col), F.lit(_ALNUM), F.lit(0)))


def alnum_tokens_sql(x: str) -> str:
    return f"array_distinct(regexp_extract_all(lower({x}), '{_ALNUM}', 0))"


def shared_count(a: Column, b: Column) -> Column:
    """Number of distinct items two arrays share."""
    return F.size(F.array_intersect(a, b))


def quoted_list_sql(arr: str) -> str:
    """Render names as ``['a', 'b']`` with backslash escapes and quote choice."""
    slash = "char(92)"
    text = f"replace(n, {slash}, {slash} || {slash})"
    for code, letter in ((10, "n"), (13, "r"), (9, "t")):
        text = f"replace({text}, char({code}), {slash} || '{letter}')"
    plain = f"char(39) || replace({text}, char(39), {slash} || char(39)) || char(39)"
    double = f"char(34) || {text} || char(34)"
    item = f"CASE WHEN contains(n, char(39)) AND NOT contains(n, char(34)) THEN {double} ELSE {plain} END"
    return f"('[' || array_join(transform({arr}, n -> {item}), ', ') || ']')"
