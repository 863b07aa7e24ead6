"""Places of pattern matches as columns, and work on lists of such places.

A span is struct<kind: string, rank: int, start: int, end: int, value: string>; places count
code points and ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches that one fold goes over.
STRETCH = 128
SPAN = "struct<kind:string,rank:int,start:int,end:int,value:string>"


def spans_of(text: Column, pattern: str, kind: str, rank: int, may: Column, keep=None) -> Column:
    """Leftmost non-overlapping matches of a Java pattern as an array of spans.

    The text is split at the matches, so that a match begins where the parts and matches
    before it end. Rows where `may` is false are not looked at. keep(value) drops matches
    without looking for others in their place.
    """
    parts = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(parts.alias("part"), found.alias("value"))
    size = lambda pair: F.length(pair["part"]) + F.coalesce(F.length(pair["value"]), F.lit(0))

    def spans(stretch: Column) -> Column:
        begin = F.struct(stretch["at"].alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

        def step(state: Column, pair: Column) -> Column:
            start = state["at"] + F.length(pair["part"])
            end = state["at"] + size(pair)
            one = F.struct(
                F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), start.alias("start"),
                end.alias("end"), pair["value"].alias("value"),
            )
            good = pair["value"].isNotNull()
            if keep is not None:
                good = good & keep(pair["value"])
            return F.struct(
                end.alias("at"),
                F.when(good, F.concat(state["out"], F.array(one))).otherwise(state["out"]).alias("out"),
            )

        return F.aggregate(stretch["rows"], begin, step, lambda state: state["out"])

    passed = lambda at, rows: F.aggregate(rows, at, lambda at, pair: at + size(pair))
    made = F.flatten(F.transform(_stretches(pairs, passed), spans))
    return F.when(may, made).otherwise(F.array().cast(f"array<{SPAN}>"))


def _bound(value: Column, work) -> Column:
    """work(value) with the value worked out once, though it is used in functions of elements."""
    return F.transform(F.array(value), work)[0]


def _stretches(rows: Column, passed) -> Column:
    """Stretches (at, rows) of STRETCH rows; `at` starts at 0, and passed(at, rows) is that of the next one.

    Adding to an array copies it, so a fold over all rows is quadratic; folds
    over stretches, and one over what each passes on, are linear up to very many rows.
    """

    def cut(all_rows: Column) -> Column:
        last = F.greatest(F.ceil(F.size(all_rows) / STRETCH).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda n: F.slice(all_rows, n * STRETCH + 1, F.lit(STRETCH)))

    def placed(parts: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        begins = F.aggregate(
            parts, begin,
            lambda s, part: F.struct(passed(s["at"], part).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")),
            lambda s: s["out"],
        )
        return F.zip_with(begins, parts, lambda at, part: F.struct(at.alias("at"), part.alias("rows")))

    return _bound(_bound(rows, cut), placed)


def beside(text: Column, spans: Column, side: int) -> Column:
    """Per span (in order of start) its value and up to `side` code points before and after it.

    Each is cut from the part of the text around its stretch of spans, not from the whole text.
    """

    def whole(all_spans: Column) -> Column:
        def stretch(n: Column) -> Column:
            part = F.slice(all_spans, n * STRETCH + 1, F.lit(STRETCH))
            begin = F.greatest(F.array_min(F.transform(part, lambda s: s["start"])) - side, F.lit(0))
            end = F.array_max(F.transform(part, lambda s: s["end"])) + side
            return F.struct(part.alias("spans"), begin.alias("at"), F.substring(text, begin + 1, end - begin).alias("text"))

        def near(part: Column, s: Column) -> Column:
            begin = F.greatest(s["start"] - side, F.lit(0))
            return F.struct(
                s["value"].alias("value"), F.substring(part["text"], begin - part["at"] + 1, s["start"] - begin).alias("before"),
                F.substring(part["text"], s["end"] - part["at"] + 1, F.lit(side)).alias("after"),
            )

        last = F.ceil(F.size(all_spans) / STRETCH).cast("int") - 1
        parts = F.transform(F.sequence(F.lit(0), last), stretch)
        return F.flatten(F.transform(parts, lambda part: F.transform(part["spans"], lambda s: near(part, s))))

    none = F.array().cast("array<struct<value:string,before:string,after:string>>")
    return F.when(F.size(spans) > 0, _bound(spans, whole)).otherwise(none)


def in_order(spans: Column) -> Column:
    """Spans by start, then rank of their kind, then end."""
    by = F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"], s["value"]))
    return F.transform(
        F.array_sort(by),
        lambda s: F.struct(
            s["kind"].alias("kind"), s["rank"].alias("rank"), s["start"].alias("start"),
            s["end"].alias("end"), s["value"].alias("value"),
        ),
    )


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def replaced(text: Column, spans: Column, label) -> Column:
    """`text` with each stretch that spans cover given as label(span); `spans` must be in order.

    A span that overlaps the stretch before it only makes that stretch longer.
    """
    passed = lambda at, rows: F.aggregate(rows, at, lambda at, s: F.greatest(at, s["end"]))

    def local(part: Column) -> Column:
        """A stretch with the text from the end of what earlier ones cover to the end of what it covers."""
        size = passed(part["at"], part["rows"]) - part["at"]
        return F.struct(
            part["rows"].alias("spans"), part["at"].alias("at"), F.substring(text, part["at"] + 1, size).alias("text")
        )

    def written(part: Column) -> Column:
        begin = F.struct(part["at"].alias("at"), F.array().cast("array<string>").alias("out"))

        def step(state: Column, s: Column) -> Column:
            between = F.substring(part["text"], state["at"] - part["at"] + 1, s["start"] - state["at"])
            more = F.concat(state["out"], F.array(between, label(s)))
            return F.struct(
                F.greatest(state["at"], s["end"]).alias("at"),
                F.when(s["start"] >= state["at"], more).otherwise(state["out"]).alias("out"),
            )

        return F.aggregate(part["spans"], begin, step, lambda state: F.array_join(state["out"], ""))

    def whole(spans: Column) -> Column:
        rest = F.substring(text, passed(F.lit(0), spans) + 1, F.length(text))
        return F.concat(F.array_join(F.transform(F.transform(_stretches(spans, passed), local), written), ""), rest)

    return F.when(F.size(spans) == 0, text).otherwise(_bound(spans, whole))
