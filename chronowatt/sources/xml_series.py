"""Time-series documents (TimeSeries / Period / Point) read and rebuilt as rows.

Spark's XML reader splits the documents; positions missing from a period are filled inside the row,
from the period's own sorted point array, so that reconstruction needs neither shuffle nor window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import timeaxis as T

# Step lengths of the document standard, in minutes.
GENERATION_STEPS = {"PT15M": 15, "PT30M": 30, "PT60M": 60}
FLOW_STEPS = {"PT15M": 15, "PT60M": 60}

_PERIOD_TYPE = (
    "STRUCT<timeInterval: STRUCT<start: STRING, end: STRING>, resolution: STRING, "
    "Point: ARRAY<STRUCT<position: INT, quantity: DOUBLE>>>"
)
TIME_SERIES = (
    "mRID STRING, `inBiddingZone_Domain.mRID` STRING, `outBiddingZone_Domain.mRID` STRING, "
    f"MktPSRType STRUCT<psrType: STRING>, Period ARRAY<{_PERIOD_TYPE}>"
)


def read_time_series(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per TimeSeries element, with its file."""
    return (
        spark.read.format("xml")
        .option("rowTag", "TimeSeries")
        .option("mode", "FAILFAST")
        .schema(TIME_SERIES)
        .load(path)
        .withColumn("file", F.input_file_name())
    )


def directed(series: DataFrame, direction: str) -> DataFrame:
    """Only the series that carry the wanted direction element (in = generation, out = load)."""
    return series.filter(F.col(f"`{direction}`").isNotNull())


def _instant(text: Column) -> Column:
    """ISO UTC text ('2024-01-01T00:00Z') as a zone-less UTC timestamp."""
    plain = F.regexp_replace(F.regexp_replace(text, "Z$", ""), "T", " ")
    return plain.cast("timestamp_ntz")


def period_steps(period: Column, steps: Mapping[str, int]) -> Column:
    """Minutes per step; an unknown resolution is an error, since it would falsify every energy."""
    table = F.create_map(*[F.lit(x) for pair in steps.items() for x in pair])
    unknown = F.raise_error(F.concat(F.lit("unknown resolution: "), F.coalesce(period.resolution, F.lit("none"))))
    return F.coalesce(F.try_element_at(table, period.resolution), unknown.cast("int"))


def rebuild_points(
    periods: DataFrame, period: str, steps: Mapping[str, int] = GENERATION_STEPS, leading: str = "error"
) -> DataFrame:
    """Every step of every period: start instant, minutes, value, whether the value was given.

    A missing position repeats the last given value, up to the end of its period and never beyond
    it. ``leading="error"`` refuses a period without its first position; ``"skip"`` starts at the
    first given one. Other columns of ``periods`` are kept.
    """
    kept = [c for c in periods.columns if c != period]
    p = F.col(period)
    d = periods.select(
        *[F.col(f"`{c}`") for c in kept],
        _instant(p.timeInterval.start).alias("__start"),
        _instant(p.timeInterval.end).alias("__end"),
        period_steps(p, steps).alias("minutes"),
        F.array_sort(F.coalesce(p.Point, F.array().cast("array<struct<position:int,quantity:double>>"))).alias("__given"),
    ).withColumn("__n", F.floor((T.minute_index("__end") - T.minute_index("__start")) / F.col("minutes")).cast("int"))
    given = F.filter("__given", lambda x: x.position <= F.col("__n"))
    if leading == "error":
        first_missing = F.size(given) == 0
        first_missing = first_missing | (F.try_element_at(given, F.lit(1)).position != 1)
        message = F.concat(F.lit("period without its first position: "), F.col("__start").cast("string"))
        given = F.when(first_missing, F.raise_error(message).cast("array<struct<position:int,quantity:double>>")).otherwise(given)
    elif leading != "skip":
        raise ValueError(f"leading must be 'error' or 'skip', not {leading!r}")
    d = d.withColumn("__given", given)

    def segment(point: Column, at: Column) -> Column:
        following = F.coalesce(F.get(F.col("__given"), at + 1).position, F.col("__n") + 1)
        return F.struct(
            point.position.alias("first"),
            point.quantity.alias("value"),
            # two points at one position: the later one counts, the earlier one covers nothing
            F.when(following > point.position, F.sequence(point.position, following - 1)).alias("positions"),
        )

    segments = d.select(
        *[F.col(f"`{c}`") for c in kept], "__start", "minutes", F.inline(F.transform("__given", segment))
    )
    return segments.select(
        *[F.col(f"`{c}`") for c in kept],
        "__start",
        "minutes",
        "first",
        "value",
        F.explode("positions").alias("position"),
    ).select(
        *[F.col(f"`{c}`") for c in kept],
        "position",
        T.plus_minutes("__start", F.col("minutes") * (F.col("position") - 1)).alias("instant"),
        "minutes",
        "value",
        (F.col("position") == F.col("first")).alias("declared"),
    )


def generation_hours(
    series: DataFrame, direction: str = "inBiddingZone_Domain.mRID", fixed_code: str | None = None
) -> DataFrame:
    """Hourly mean power per code: date_heure (UTC), code, mw. Sub-hourly steps are averaged."""
    code = F.lit(fixed_code) if fixed_code else F.col("MktPSRType.psrType")
    periods = directed(series, direction).select(code.alias("code"), F.explode("Period").alias("period"))
    steps = rebuild_points(periods, "period", GENERATION_STEPS, "error")
    return steps.groupBy(T.floor_hour("instant").alias("date_heure"), "code").agg(F.avg("value").alias("mw"))


def flow_points(series: DataFrame, **labels: Column) -> DataFrame:
    """Point-level physical flow with its duration: date_heure_utc, minutes, mw, declare."""
    periods = series.select(*[c.alias(n) for n, c in labels.items()], F.explode("Period").alias("period"))
    steps = rebuild_points(periods, "period", FLOW_STEPS, "skip")
    return steps.select(
        *labels, F.col("instant").alias("date_heure_utc"), "minutes", F.col("value").alias("mw"),
        F.col("declared").alias("declare"),
    )


def document_text(series_id: Column, points: list[tuple[Column, Column]], resolution: str, start: str, end: str) -> Column:
    """A TimeSeries element written from columns, one Point per pair whose quantity is not NULL."""
    body = [
        F.coalesce(
            F.concat(
                F.lit("<Point><position>"), pos.cast("string"), F.lit("</position><quantity>"), qty.cast("string"),
                F.lit("</quantity></Point>"),
            ),
            F.lit(""),
        )
        for pos, qty in points
    ]
    return F.concat(
        F.lit("<TimeSeries><mRID>"),
        series_id.cast("string"),
        F.lit(
            f"</mRID><Period><timeInterval><start>{start}</start><end>{end}</end></timeInterval>"
            f"<resolution>{resolution}</resolution>"
        ),
        *body,
        F.lit("</Period></TimeSeries>"),
    )


def parse_text(df: DataFrame, text: str, kept: Sequence[str] = ()) -> DataFrame:
    """TimeSeries elements held in a text column; a malformed one is an error."""
    parsed = F.from_xml(F.col(text), TIME_SERIES, {"mode": "FAILFAST"})
    return df.select(*kept, parsed.alias("__ts")).select(*kept, "__ts.*")
