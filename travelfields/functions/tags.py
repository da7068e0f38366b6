"""Road rules read from a map of tags."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _tag(tags: Column, key: str) -> Column:
    return F.coalesce(tags[key], F.lit(""))


def is_private(tags: Column) -> Column:
    """Closed to cars. An explicit permission for motor vehicles beats a general access rule, nothing else."""
    closed = lambda key: F.lower(F.trim(_tag(tags, key))).isin("private", "no", "customers", "permit")
    allowed = F.lower(_tag(tags, "motor_vehicle")).isin("yes", "designated", "permissive")
    return (closed("access") & ~allowed) | closed("motor_vehicle") | closed("vehicle")


def oneway(tags: Column, highway: Column) -> Column:
    """1 along the way, -1 against it, 0 both. A stated direction beats the one that roundabouts and motorways imply."""
    said = F.lower(F.trim(_tag(tags, "oneway")))
    implied = F.lower(_tag(tags, "junction")).isin("roundabout", "circular") | highway.isin("motorway", "motorway_link")
    return (
        F.when(said.isin("yes", "true", "1"), 1).when(said.isin("-1", "reverse"), -1).when(said.isin("no", "false", "0"), 0)
        .when(implied, 1).otherwise(0)
    )


def maxspeed(tags: Column) -> Column:
    """The limit in km/h, if its first word is a number from 5 to 130."""
    word = F.regexp_replace(F.split(F.lower(F.trim(_tag(tags, "maxspeed"))), "\\s+")[0], ",", ".")
    number = F.when(word.rlike("^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?$"), word.try_cast("double"))
    return F.when(number.between(5.0, 130.0), number)


def freeflow_speed(tags: Column, class_kmh: Column) -> Column:
    limit = maxspeed(tags)
    return F.least(class_kmh.cast("double"), F.coalesce(limit, class_kmh.cast("double")))


def quantise(length_m: Column, kmh: Column) -> tuple[Column, Column]:
    """(tenths of a second at free flow, whole metres), half to even, 1 to 65535."""
    clamp = lambda c: F.greatest(F.lit(1), F.least(F.lit(65535), F.bround(c, 0).cast("int")))
    return clamp(length_m / (kmh / 3.6) * 10), clamp(length_m)
