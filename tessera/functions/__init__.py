"""Functions beyond Spark's own, as expressions that stay in the JVM; and macros that let SQL text use them by name."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: What parts terms: anything that is neither a letter nor a number.
NOT_TERM = r"[^\p{IsAlphabetic}\p{N}]+"
#: log2 of a sketch's registers.
SKETCH_LG = 14


def terms_sql(text: str) -> str:
    """The terms of an SQL expression, repeats kept: the one definition, for columns, indexes and the words that are looked for."""
    pattern = NOT_TERM.replace("\\", "\\\\")
    return f"array_remove(split(lower({text}), '{pattern}'), '')"


def terms(text: str, spark: SparkSession | None = None) -> list[str]:
    """Terms of a query text, repeats kept; evaluated by Spark on the driver, without a job."""
    return (spark or SparkSession.getActiveSession()).sql(f"SELECT {terms_sql(_quoted(text))}").first()[0]


def text_terms(column: str) -> Column:
    return F.expr(terms_sql(column))


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches_sql(column: str, query: str) -> str:
    """Every term of query is a term of the text; null for a null text; true if query has no terms."""
    return f"(CASE WHEN {column} IS NULL THEN NULL ELSE size(array_except({terms_sql(_quoted(query))}, {terms_sql(column)})) = 0 END)"


def text_matches(column: str, query: str) -> Column:
    return F.expr(matches_sql(column, query))


def _vector_checks(v: str, q: str, body: str) -> str:
    return f"(CASE WHEN {v} IS NULL OR {q} IS NULL THEN double('Infinity') WHEN size({v}) <> size({q}) THEN raise_error('vectors of different dimensions') WHEN exists({v}, x -> x IS NULL) THEN raise_error('null within a vector') ELSE {body} END)"


def l2_sql(v: str, q: str) -> str:
    """Squared Euclidean distance; infinite for a null vector."""
    return _vector_checks(v, q, f"aggregate(zip_with(cast({v} AS array<double>), cast({q} AS array<double>), (a, b) -> (a - b) * (a - b)), 0D, (s, x) -> s + x)")


def cosine_sql(v: str, q: str) -> str:
    """One less the cosine; infinite for null and zero vectors."""
    dot = lambda a, b: f"aggregate(zip_with(cast({a} AS array<double>), cast({b} AS array<double>), (a, b) -> a * b), 0D, (s, x) -> s + x)"
    norms = f"(sqrt({dot(v, v)}) * sqrt({dot(q, q)}))"
    return _vector_checks(v, q, f"CASE WHEN {norms} = 0 THEN double('Infinity') ELSE 1 - {dot(v, q)} / {norms} END")


def l2_distance(v: str, q: list[float] | str) -> Column:
    return F.expr(l2_sql(v, q if isinstance(q, str) else array_sql(q)))


def cosine_distance(v: str, q: list[float] | str) -> Column:
    return F.expr(cosine_sql(v, q if isinstance(q, str) else array_sql(q)))


def array_sql(values: list[float]) -> str:
    return "array(" + ", ".join(f"{x!r}D" for x in map(float, values)) + ")"


def hll_state(column: str) -> Column:
    """A mergeable sketch of the distinct non-null values."""
    return F.hll_sketch_agg(F.col(column), F.lit(SKETCH_LG))


def hll_merge(column: str) -> Column:
    """The number of distinct values in merged sketches."""
    return F.hll_sketch_estimate(F.hll_union_agg(F.col(column)))


@dataclass(frozen=True)
class Called:
    """A function that SQL text uses: its name, the column, and the number of elements of a literal vector."""

    name: str
    column: str
    size: int | None = None
    query: str | None = None


#: Text in which nothing is looked for: literals, quoted names and comments.
_APART = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/"""
_CALL = re.compile(rf"{_APART}|\b(text_matches|l2_distance|cosine_distance)\s*\(", re.I | re.S)
_PART = re.compile(rf"({_APART})|[(\[]|[)\]]|,", re.S)


def _arguments(sql: str, at: int) -> tuple[list[str], int]:
    """Comma-separated arguments from just behind an opening parenthesis, and the place behind the closing one."""
    depth, start, out = 0, at, []
    for m in _PART.finditer(sql, at):
        c = m[0]
        if m[1] is not None:
            continue
        if c in "([":
            depth += 1
        elif c in ")]":
            if depth == 0:
                return [*out, sql[start : m.start()].strip()], m.end()
            depth -= 1
        elif depth == 0:
            out.append(sql[start : m.start()].strip())
            start = m.end()
    raise ValueError("unbalanced parentheses")


def expand(sql: str) -> tuple[str, list[Called]]:
    """SQL with the named functions replaced by their expressions, and what was called."""
    out, calls, at, seen = [], [], 0, 0
    while m := _CALL.search(sql, seen):
        seen = m.end()
        if m[1] is None:
            continue
        name = m[1].lower()
        args, stop = _arguments(sql, m.end())
        if len(args) != 2:
            raise ValueError(f"{name} takes two arguments")
        if name == "text_matches":
            if not re.fullmatch(r"'(?:[^'\\]|\\.|'')*'", args[1], re.S):
                raise ValueError("the second argument of text_matches is a string literal")
            query = re.sub(r"\\(.)", r"\1", args[1][1:-1].replace("''", "'"))
            text = matches_sql(args[0], query)
            calls.append(Called(name, args[0].split(".")[-1].strip("`"), None, query))
        else:
            v, q = (args[1], args[0]) if args[0].lower().startswith("array") else (args[0], args[1])
            text = (l2_sql if name == "l2_distance" else cosine_sql)(v, q)
            literal = re.fullmatch(r"array\s*\((.*)\)", q, re.I | re.S)
            calls.append(Called(name, v.split(".")[-1].strip("`"), len(_arguments(literal[1] + ")", 0)[0]) if literal else None))
        out += [sql[at : m.start()], text]
        at = seen = stop
    return "".join([*out, sql[at:]]), calls
