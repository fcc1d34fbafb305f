"""Vessel types and their categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Categories and types in their natural order; a text that fits several types takes the first.
CATEGORIES: dict[str, list[str]] = {
    "Cargo Vessels": ["General Cargo", "Dry Bulk", "Ro-Ro/Vehicle Carrier", "Reefer", "Miscellaneous Cargo", "Multi Purpose Carrier", "Log Carrier", "Aggregates Carrier", "Cement Carrier", "Heavy Lift", "Tween Decker", "Self Discharging", "Deck Cargo", "Limestone Carrier"],
    "Tanker Vessels": ["Crude Tanker", "Chemical Tanker", "Product Tanker", "General Tanker", "Bitumen Carrier", "Veg Oil Carrier", "Water Tanker", "Bunkering"],
    "Gas Carriers": ["LNG Carrier", "LPG Carrier"],
    "Container Vessels": ["Container"],
    "Passenger Vessels": ["Passenger Ship", "Ro-Ro/Passenger", "High Speed Craft"],
    "Service Vessels": ["Tug", "Tug/Supply Vessel", "Pusher Tug", "Support Vessel", "Supply Vessel", "Port Tender", "Pilot Vessel", "Dredger", "Icebreaker", "Anchor Hoy", "Utility Vessel", "Research Vessel", "Salvage Vessel", "Dive Vessel", "Drilling Vessel", "Work/Repair Vessel", "Anti Pollution", "Search And Rescue", "Law Enforcement", "Patrol Vessel", "Medical", "Power Station Vessel"],
    "Fishing Vessels": ["Fishing Vessel", "Fish Carrier"],
    "Pleasure Craft": ["Other Pleasure Craft", "Sailing", "Yacht"],
    "Naval Vessels": ["Naval Vessel"],
    "Offshore Vessels": ["Offshore Processing Vessel"],
    "Other": ["Unspecified", "Other Special Craft"],
}


def tree(spark: SparkSession) -> DataFrame:
    """(category, type, category_order, type_order): the whole tree, some dozen rows."""
    rows = [(c, t, i, j) for i, (c, types) in enumerate(CATEGORIES.items()) for j, t in enumerate(types)]
    return spark.createDataFrame(rows, "category string, type string, category_order int, type_order int")


def category_of(vessel_type: Column) -> Column:
    """The category: of the same type, else of the first type that contains the text or is contained, else Other.

    Null, blank and the text nan have the empty category. One chain of conditions, no join.
    """
    text = F.trim(vessel_type)
    low = F.lower(text)
    exact = F.create_map(*[F.lit(x) for c, types in CATEGORIES.items() for t in types for x in (t, c)])
    near = None
    for category, types in CATEGORIES.items():
        hit = F.lit(False)
        for t in types:
            hit = hit | F.contains(low, F.lit(t.lower())) | F.contains(F.lit(t.lower()), low)
        near = F.when(hit, F.lit(category)) if near is None else near.when(hit, F.lit(category))
    empty = vessel_type.isNull() | (text == "") | (low == "nan")
    return F.when(empty, F.lit("")).otherwise(F.coalesce(F.try_element_at(exact, text), near, F.lit("Other")))
