"""The read-filter language: || of && of comparisons, parsed on the driver to one Column.

    or := and ('||' and)*    and := pred ('&&' pred)*    pred := '(' or ')' | term cmp term
    cmp := < <= > >= == !=   term := zm | ln | rq | bc1 | bc2 | bq | np | qs | qe | digits

rq is the quality times 1000, in single precision, with its fraction cut off. Anything left over
after a complete expression is an error, as is any other fault; no default stands in for it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VARIABLES = frozenset(("zm", "ln", "rq", "bc1", "bc2", "bq", "np", "qs", "qe"))
DEFAULT = "ln>=500 && rq>=750"
_TOKENS = re.compile(r"\s*(?:(\|\||&&|<=|>=|==|!=|[<>()])|([a-z]+\d?)|(\d+))")


def rq_of(quality: Column) -> Column:
    return (F.lit(1000).cast("float") * quality.cast("float")).cast("int")


def parse(text: str, columns: dict[str, Column] | None = None) -> tuple[Column, set[str]]:
    """The condition, and the variables it reads."""
    tokens: list[str] = []
    at, end = 0, len(text.rstrip())
    while at < end:
        m = _TOKENS.match(text, at)
        if not m:
            raise ValueError(f"unexpected text at {text[at:]!r}")
        tokens.append(m[1] or m[2] or m[3])
        at = m.end()
    used: set[str] = set()
    place = 0

    def take(*wanted: str) -> str | None:
        nonlocal place
        if place < len(tokens) and tokens[place] in wanted:
            place += 1
            return tokens[place - 1]
        return None

    def term() -> Column:
        nonlocal place
        word = tokens[place] if place < len(tokens) else ""
        place += 1
        if word.isdigit():
            return F.lit(int(word))
        if word not in VARIABLES:
            raise ValueError(f"not a variable or a number: {word!r}")
        used.add(word)
        return (columns or {}).get(word, F.col(word))

    def predicate() -> Column:
        if take("("):
            inner = either()
            if not take(")"):
                raise ValueError("a parenthesis is not closed")
            return inner
        left = term()
        sign = take("<", "<=", ">", ">=", "==", "!=")
        if sign is None:
            raise ValueError("a comparison is missing")
        right = term()
        return {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right, "==": left == right, "!=": left != right}[sign]

    def both() -> Column:
        out = predicate()
        while take("&&"):
            out = out & predicate()
        return out

    def either() -> Column:
        out = both()
        while take("||"):
            out = out | both()
        return out

    out = either()
    if place != len(tokens):
        raise ValueError(f"left over: {' '.join(tokens[place:])!r}")
    return out, used


def keep(reads: DataFrame, text: str = DEFAULT, columns: dict[str, Column] | None = None, required: bool = False) -> DataFrame:
    """Reads that pass; with `required`, a null in a variable of the expression is an error."""
    condition, used = parse(text, columns)
    if required:
        for name in sorted(used):
            c = (columns or {}).get(name, F.col(name))
            condition = F.when(c.isNull(), F.raise_error(F.lit(f"a read lacks {name}")).cast("boolean")).otherwise(condition)
    return reads.filter(condition)
