"""Timed events: window after an anchor, first values, one text per owner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def within_hours(
    events: DataFrame, hours: int, time: str = "storetime",
    start: str = "admittime", end: str = "dischtime",
) -> DataFrame:
    """Events from ``start`` to ``start`` + hours (inclusive) and not after ``end``."""
    upper = F.col(start) + F.make_dt_interval(hours=F.lit(hours))
    return events.filter(
        F.col(time).between(F.col(start), upper) & (F.col(time) <= F.col(end))
    )


def first_per_item(
    events: DataFrame, keys: list[str], values: list[str], time: str = "storetime"
) -> DataFrame:
    """First non-null value of every column per key, in time order.

    Each column is one mergeable aggregate, so a key with very many events is
    reduced on the map side. Equal times are settled by the smaller value.
    """
    firsts = [
        F.min(F.when(F.col(v).isNotNull(), F.struct(F.col(time), F.col(v))))[v].alias(v)
        for v in values
    ]
    return events.groupBy(*keys).agg(*firsts)


def event_text(parts: list[Column]) -> Column:
    """The parts that hold something, separated by a space."""
    texts = [p.cast("string") for p in parts]
    kept = [F.when(~F.lower(t).isin("nan", "none", ""), t) for t in texts]
    return F.concat_ws(" ", *kept)


def text_per_owner(events: DataFrame, owner: str, item: str, text: Column) -> DataFrame:
    """All event texts of an owner joined by `` | `` in item order.

    Call it after :func:`first_per_item`: a group then has one row per item.
    """
    ordered = F.sort_array(F.collect_list(F.struct(F.col(item).alias("i"), text.alias("t"))))
    return events.groupBy(owner).agg(
        F.array_join(F.transform(ordered, lambda e: e["t"]), " | ").alias("labs")
    )


def lab_summaries(labevents: DataFrame, admissions: DataFrame, hours: int = 12) -> DataFrame:
    """One ``labs`` text per admission from the first value of every item."""
    timed = labevents.join(admissions, "hadm_id")
    firsts = first_per_item(
        within_hours(timed, hours), ["hadm_id", "itemid"],
        ["valuenum", "valueuom", "label", "flag"],
    )
    text = event_text([F.col(c) for c in ("valuenum", "valueuom", "label", "flag")])
    return text_per_owner(firsts, "hadm_id", "itemid", text)


def add_lab_data(
    notes: DataFrame, labevents: DataFrame, admissions: DataFrame, hours: int = 12
) -> DataFrame:
    """Notes with their ``labs`` text, null where no event falls into the window."""
    return notes.join(lab_summaries(labevents, admissions, hours), "hadm_id", "left")
