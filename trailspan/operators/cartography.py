"""Rules of a base map: classes of roads, numbers on shields, and at which zoom things appear."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Functional classes, feature codes that demote or drop a road, rank of the classes.
FUNCTIONAL = {1: "motorway", 2: "motorway", 3: "trunk", 4: "primary", 5: "secondary", 6: "tertiary", 7: "minor"}
FLOOR = {"S1400": "minor", "S1200": "secondary"}
DROPPED = ["S1500", "S1640", "S1710", "S1720", "S1730", "S1740", "S1750", "S1780", "S1820", "S1830"]
RANK = {"motorway": 5, "trunk": 4, "primary": 3, "secondary": 2, "tertiary": 1, "minor": 0, "link": 0}


def _map(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def shield(interstate: Column, us_route: Column, state_route: Column) -> Column:
    """First of the three fields with a number gives the text: prefix, at most two numbers, and a qualifier that stands first.
    State numbers from 600 on do not count; no number gives the empty text."""

    def one(field: Column, prefix: str, most: int | None) -> Column:
        parts = F.filter(F.transform(F.split(F.coalesce(field, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")
        numbers = F.filter(parts, lambda p: p.rlike(r"^\d+$") & ((p.try_cast("long") < most) if most else F.lit(True)))
        head = F.try_element_at(parts, F.lit(1))
        suffix = F.when(head.rlike(r"^\d+$"), "").otherwise(F.concat(F.lit(" "), head))
        return F.when(F.size(numbers) > 0, F.concat(F.lit(prefix), F.array_join(F.slice(numbers, 1, 2), "/"), suffix))

    return F.coalesce(one(interstate, "I-", None), one(us_route, "US ", None), one(state_route, "VA ", 600), F.lit(""))


def road_class(functional: Column, feature: Column, ref: Column) -> Column:
    """Class by function, demoted by the feature code where no shield says otherwise; dropped codes give null."""
    code = F.trim(F.coalesce(feature, F.lit("")))
    base = F.when(code == "S1630", "link").otherwise(F.coalesce(_map(FUNCTIONAL, F.coalesce(F.nullif(functional, F.lit(0)), F.lit(7)).cast("int")), F.lit("minor")))
    floor = F.when(ref == "", _map(FLOOR, code))
    return F.when(code.isin(*DROPPED), None).otherwise(F.when(_map(RANK, floor) < _map(RANK, base), floor).otherwise(base))


def first_zoom(visibility: Column) -> Column:
    v = F.coalesce(visibility, F.lit(0))
    return F.when(v >= 1000000, 7).when(v >= 500000, 9).when(v >= 250000, 10).when(v >= 100000, 11).otherwise(13)


def place_rank(population: Column) -> Column:
    p = F.coalesce(population, F.lit(0))
    return F.when(p >= 20000, 1).when(p >= 5000, 2).when(p >= 1000, 3).otherwise(4)


def overlaps(x0: Column, y0: Column, x1: Column, y1: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether two boxes meet: four comparisons that reach the file statistics."""
    return (x0 <= box[2]) & (x1 >= box[0]) & (y0 <= box[3]) & (y1 >= box[1])


def thinned(line: Column, step: int) -> Column:
    """Every ``step``-th point, and the last."""
    return F.filter(line, lambda p, i: (i % step == 0) | (i == F.size(line) - 1))
