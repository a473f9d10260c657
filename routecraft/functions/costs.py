"""Per-observation cost terms (Catalyst expressions, no Python per row).

Operation order follows the cost model exactly so that doubles agree bit for
bit with any SQL engine evaluating the same formula. Divisions use
``try_divide`` so a zero capacity or road factor yields null (ignored by
aggregates) instead of failing the whole query under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import FUEL_EFFICIENCY_BASE, HOURLY_RATE, REFERENCE_CAPACITY_TONS, TIME_WEIGHT


def _c(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def distance_cost(distance="distance_km", rate="base_rate_per_km", road="road_condition_factor") -> Column:
    """distance x base rate x road factor."""
    return _c(distance) * _c(rate) * _c(road)


def fuel_efficiency(capacity="vehicle_capacity_tons", road="road_condition_factor") -> Column:
    """8 x (capacity / 10) x (1 / road factor)."""
    return (F.lit(FUEL_EFFICIENCY_BASE) * (_c(capacity) / F.lit(REFERENCE_CAPACITY_TONS))
            * F.try_divide(F.lit(1.0), _c(road)))


def fuel_cost(distance="distance_km", capacity="vehicle_capacity_tons", road="road_condition_factor",
              fuel="fuel_price_per_liter") -> Column:
    """distance / fuel efficiency x fuel price."""
    return F.try_divide(_c(distance), fuel_efficiency(capacity, road)) * _c(fuel)


def time_cost(hours="travel_time_hours") -> Column:
    """hours x hourly rate x time weight."""
    return _c(hours) * F.lit(HOURLY_RATE) * F.lit(TIME_WEIGHT)


def capacity_factor(capacity="vehicle_capacity_tons") -> Column:
    """10 / capacity tons."""
    return F.try_divide(F.lit(REFERENCE_CAPACITY_TONS), _c(capacity))


def composite_cost(seasonal="seasonal_factor", priority="priority_multiplier") -> Column:
    """(distance + fuel + time cost) x capacity factor x seasonal x priority."""
    return ((distance_cost() + fuel_cost() + time_cost())
            * capacity_factor() * _c(seasonal) * _c(priority))
