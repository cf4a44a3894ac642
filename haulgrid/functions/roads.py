"""Road attributes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Drivable highway classes and their speed in km/h where no limit is mapped.
CLASS_SPEED = {
    "motorway": 110, "trunk": 80, "primary": 50, "secondary": 50, "tertiary": 50, "unclassified": 40, "residential": 30,
    "living_street": 10, "service": 20, "road": 30, "motorway_link": 60, "trunk_link": 50, "primary_link": 40,
    "secondary_link": 40, "tertiary_link": 30,
}


def drivable(highway: Column, access: Column, motor_vehicle: Column, area: Column) -> Column:
    no = F.lit("no")
    return (
        highway.isin(*CLASS_SPEED) & ~access.eqNullSafe(no) & ~motor_vehicle.eqNullSafe(no) & ~area.eqNullSafe(F.lit("yes"))
    )


def edge_speed(highway: Column, maxspeed: Column) -> Column:
    """Leading digits of the mapped limit, else the speed of the class."""
    table = F.create_map(*[F.lit(v) for pair in CLASS_SPEED.items() for v in (pair[0], float(pair[1]))])
    digits = F.regexp_extract(F.coalesce(maxspeed, F.lit("")), r"^(\d+)", 1)
    return F.when(digits != "", digits.cast("double")).otherwise(table[highway])


def directions(highway: Column, oneway: Column, junction: Column) -> tuple[Column, Column]:
    """(forward, backward) of a way."""
    tag, round_ = F.coalesce(oneway, F.lit("no")), F.coalesce(junction, F.lit(""))
    single = tag.isin("yes", "1", "true") | round_.isin("roundabout", "circular") | (highway == "motorway")
    return tag != "-1", F.when(tag == "-1", F.lit(True)).otherwise(~single)


def speed_variants(length_m: Column, time_s: Column) -> dict[str, Column]:
    """Seconds per edge: mapped speed, 25 km/h throughout, congested (60 % of mapped, 40 at most)."""
    speed = length_m / time_s * 3.6
    return {
        "tt_mapped": time_s,
        "tt_uniform25": length_m / F.lit(25 / 3.6),
        "tt_congested": length_m / (F.least(speed * 0.6, F.lit(40.0)) / 3.6),
    }
