"""What a measurement is: any DataFrame plus the roles of its columns."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import NotFound
from tidemark.functions.scalar import series_id


@dataclass(frozen=True, eq=False)
class Measurement:
    """A DataFrame bound to a time column, tag, field and tiebreak columns.

    Tags and fields stay real columns, so filters on them reach the scan. The tiebreak columns order points of
    equal time and should make rows unique; the last of equal points is the one with the largest tiebreak.
    day: partition column derived from the time, if the source has one.
    """

    source: DataFrame
    time: str
    tags: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()
    tiebreak: tuple[str, ...] = ()
    name: str = ""
    day: str | None = None

    def __post_init__(self) -> None:
        known = set(self.source.columns)
        if lost := [c for c in (self.time, *self.tags, *self.fields, *self.tiebreak, *([self.day] if self.day else [])) if c not in known]:
            raise NotFound(f"columns {lost} are not in the source of measurement {self.name!r}")

    @classmethod
    def of_points(cls, points: DataFrame, measurement: str, tags: tuple[str, ...], field: str = "value") -> Measurement:
        """Points (measurement, ts, tags map, value, seq) of one measurement, by exact name, with map entries as tag columns."""
        own = points.where(F.col("measurement") == measurement)
        columns = [F.col("tags")[t].alias(t) for t in tags]
        return cls(own.select("ts", *columns, F.col("value").alias(field), "seq"), "ts", tags, (field,), ("seq",), measurement)

    def field(self, name: str | None = None) -> str:
        """A field by name; without one, the first."""
        chosen = name or (self.fields[0] if self.fields else None)
        if chosen is None or chosen not in self.fields:
            raise NotFound(f"measurement {self.name!r} has no field {name!r}")
        return chosen

    def tag(self, name: str) -> str:
        if name not in self.tags:
            raise NotFound(f"measurement {self.name!r} has no tag {name!r}")
        return name

    def order(self, ascending: bool = True) -> list[Column]:
        """Sort columns: time, then tiebreak."""
        return [F.col(c).asc() if ascending else F.col(c).desc() for c in (self.time, *self.tiebreak)]

    def moment(self) -> Column:
        """Time and tiebreak as one comparable value."""
        return F.struct(*(F.col(c) for c in (self.time, *self.tiebreak)))

    def series_id(self) -> Column:
        """Number of the row's series, the same for any order of tags."""
        return series_id(F.lit(self.name), {t: F.col(t) for t in self.tags})

    def over(self, source: DataFrame) -> Measurement:
        """The same roles on another DataFrame."""
        return replace(self, source=source)
