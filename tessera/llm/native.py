"""Column expressions for texts that more than one native operator uses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = "struct<start:int,end:int,value:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Runs of [^\\x20\\x09-\\x0D]."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def marked_spans(text: Column, head: str, value: str) -> Column:
    """Leftmost non-overlapping matches of head followed by value, as (start, end, value) in code points.

    The matches are put between marks, and the pieces' lengths give the places. text must be free of \\x01 and \\x02; see unmarked().
    """
    marked = F.regexp_replace(text, F.lit(f"({head})({value})"), F.lit("\x01$1\x02$2\x01"))
    empty = F.expr(f"cast(array() as array<{_SPAN}>)")

    def spans(pieces: Column) -> Column:
        # places are gathered as text: a state that holds an array would be cast element by element at each step
        start = F.struct(F.lit(0).alias("pos"), F.lit(False).alias("inside"), F.lit("").alias("out"))

        def step(s: Column, piece: Column) -> Column:
            stop = s["pos"] + F.length(piece) - F.when(s["inside"], 1).otherwise(0)
            place = F.when(s["inside"], F.concat(s["pos"].cast("string"), F.lit(":"), stop.cast("string"), F.lit(";"))).otherwise("")
            return F.struct(stop.alias("pos"), (~s["inside"]).alias("inside"), F.concat(s["out"], place).alias("out"))

        values = F.filter(pieces, lambda p, i: i % 2 == 1)
        places = F.slice(F.split(F.aggregate(pieces, start, step, lambda s: s["out"]), ";"), 1, F.size(values))
        both = F.zip_with(places, values, lambda p, v: F.struct(F.substring_index(p, ":", 1).cast("int").alias("start"), F.substring_index(p, ":", -1).cast("int").alias("end"), F.substring_index(v, "\x02", -1).alias("value")))
        return both.cast(f"array<{_SPAN}>")

    def found(m: Column) -> Column:
        return F.when(F.instr(m, "\x01") > 0, let(F.split(m, "\x01"), spans)).otherwise(empty)

    return let(marked, found)


def unmarked(text: Column) -> Column:
    """text with the marks' characters replaced one for one by another that no pattern takes."""
    return F.when((F.instr(text, "\x01") > 0) | (F.instr(text, "\x02") > 0), F.translate(text, "\x01\x02", "\x03\x03")).otherwise(text)
