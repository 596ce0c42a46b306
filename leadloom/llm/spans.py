"""Regex matches of a text column with their places, as DataFrame expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once, also where `then` uses it per element."""
    return F.get(F.transform(F.array(value), then), 0)


def running(values: Column, fold: Callable[[Column, Column], Column]) -> Column:
    """array<int>: for each place, all values before it folded from 0 (`fold` associative, 0 neutral).

    Arrays cannot grow in place, so a fold that appends costs the square of the length. Blocks of about the
    square root of it are folded each for itself, then the totals of the blocks.
    """
    def folded(part: Column) -> Column:
        step = lambda acc, v: F.struct(fold(acc["now"], v).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out"))
        return F.aggregate(part, F.struct(F.lit(0).alias("now"), F.array().cast("array<int>").alias("out")), step)

    def of_blocks(inside: Column) -> Column:
        offsets = folded(F.transform(inside, lambda x: x["now"]))["out"]
        return F.flatten(F.zip_with(inside, offsets, lambda x, o: F.transform(x["out"], lambda v: fold(o, v))))

    def of_values(all_values: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(all_values))).cast("int")
        cut = lambda w: F.transform(F.sequence(F.lit(1), F.size(all_values), w), lambda i: folded(F.slice(all_values, i, w)))
        return F.when(F.size(all_values) > 0, _let(_let(width, cut), of_blocks)).otherwise(F.array().cast("array<int>"))

    return _let(values, of_values)


#: Code points of one block of a text that is cut at many places.
BLOCK = 1_024


def _pieces(text: Column, cuts: Callable[[Callable[[Column, Column], Column]], Column]) -> Column:
    """`cuts` of a function (begin, end) -> that part of `text`, whose cost does not grow with its place: a plain
    substring walks over all signs before it."""
    def of_blocks(blocks: Column) -> Column:
        def part(begin: Column, end: Column) -> Column:
            first = F.floor(begin / BLOCK).cast("int")
            count = F.floor((end - 1) / BLOCK).cast("int") - first + 1
            near = F.array_join(F.slice(blocks, first + 1, F.greatest(count, F.lit(0))), "")
            return F.when(end > begin, F.substring(near, begin - first * BLOCK + 1, end - begin)).otherwise("")

        return cuts(part)

    return _let(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0)), of_blocks)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start int, stop int, value string>> of the leftmost non-overlapping matches.

    Places count code points, `stop` is exclusive. The pieces between the matches and the matches
    themselves alternate, so running sums of their lengths give the places. A text without a match
    costs one `rlike`; null gives an empty array.
    """
    empty = F.array().cast("array<struct<start:int,stop:int,value:string>>")
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(pairs: Column) -> Column:
        both = F.transform(pairs, lambda x: F.length(x["piece"]) + F.coalesce(F.length(x["value"]), F.lit(0)))

        def one(x: Column, at: Column) -> Column:
            begin = at + F.length(x["piece"])
            return F.struct(begin.alias("start"), (begin + F.length(x["value"])).alias("stop"), x["value"].alias("value"))

        return F.filter(F.zip_with(pairs, running(both, lambda a, b: a + b), one), lambda x: x["value"].isNotNull())

    pairs = F.arrays_zip(pieces.alias("piece"), found.alias("value"))
    return F.when(text.rlike(pattern), _let(pairs, placed)).otherwise(empty)


def tagged(spans: Column, kind: str, order: int) -> Column:
    """Matches as array<struct<kind, rank, start, stop>>."""
    return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(order).alias("rank"), x["start"].alias("start"), x["stop"].alias("stop")))


def no_spans() -> Column:
    return F.array().cast("array<struct<kind:string,rank:int,start:int,stop:int>>")


def _text(x: Column) -> Column:
    return F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))


def joined_by_start(spans: Column) -> Column:
    """`kind:start:end` by start, then kind as listed, comma-joined."""
    keyed = F.transform(spans, lambda x: F.struct(x["start"], x["rank"], x["stop"], x["kind"]))
    return F.concat_ws(",", F.transform(F.array_sort(keyed), _text))


def joined_by_kind(spans: Column) -> Column:
    """`kind:start:end` by kind as listed, then start, comma-joined."""
    keyed = F.transform(spans, lambda x: F.struct(x["rank"], x["start"], x["stop"], x["kind"]))
    return F.concat_ws(",", F.transform(F.array_sort(keyed), _text))


def _rebuilt(text: Column, spans: Column, keyed: Column, instead: Callable[[Column, Column], Column]) -> Column:
    """`text` with `instead(span, begin)` for each of its spans, sorted as `keyed`, `begin` being the end of those before it."""
    def of_spans(keyed: Column) -> Column:
        def of_ends(ends: Column) -> Column:
            def texts(part: Callable[[Column, Column], Column]) -> Column:
                done = F.transform(F.arrays_zip(keyed.alias("x"), ends.alias("at")), lambda p: F.concat(part(p["at"], p["x"]["start"]), instead(p["x"], p["at"])))
                return F.concat(F.array_join(done, ""), part(F.array_max(F.transform(keyed, lambda x: x["stop"])), F.length(text)))

            return _pieces(text, texts)

        return _let(running(F.transform(keyed, lambda x: x["stop"]), F.greatest), of_ends)

    return F.when(F.size(spans) > 0, _let(keyed, of_spans)).otherwise(text)


def replaced(text: Column, spans: Column) -> Column:
    """`text` with each span replaced by its kind in angle brackets; spans that overlap an earlier one
    are covered by the earlier one's replacement up to their end."""
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"], x["rank"], x["stop"], x["kind"])))
    return _rebuilt(text, spans, keyed, lambda x, at: F.when(x["start"] >= at, F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">"))).otherwise(""))


def blanked(text: Column, spans: Column) -> Column:
    """`text` with spaces in place of the spans, so that all else keeps its place."""
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"], x["stop"])))
    return _rebuilt(text, spans, keyed, lambda x, at: F.repeat(F.lit(" "), F.greatest(x["stop"] - F.greatest(x["start"], at), F.lit(0))))
