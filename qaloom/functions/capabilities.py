"""Capability codes and groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qaloom.functions.text import blank, token

#: Capability names and their codes.
CODES = {
    "object_identification": "1a", "instance_matching": "1b", "object_attributes": "1c", "spatial_localization_camera": "1d", "spatial_localization_situs": "1e",
    "temporal_localization": "2a", "duration_estimation": "2b",
    "object_aggregation": "3a", "event_aggregation": "3b",
    "fo_interaction_recognition": "4a", "fo_usage_purpose": "4b", "temporal_ordering": "4c",
    "functional_reasoning": "5a", "causal_consequence_reasoning": "5b", "multi_step_reasoning": "5c",
}
GROUPS = ("object_recognition", "temporal_grounding", "aggregation", "event_understanding", "complex_reasoning")


def code(given: Column, name: Column) -> Column:
    """A given code, else the code of a known name, else the name."""
    known = F.create_map(*(F.lit(x) for pair in CODES.items() for x in pair))
    return F.coalesce(F.nullif(given, F.lit("")), F.try_element_at(known, name), name)


def code_group(capability: Column) -> Column:
    """First digit of a code."""
    return F.substring(capability, 1, 1)


def group(text: Column, strict: bool = False) -> Column:
    """Metric name of a capability group, found as a part of its name; null if there is none, or an error if strict and the name isn't blank."""
    t = token(text)
    known = (
        F.when(t.contains("object_recognition"), "object_recognition")
        .when(t.contains("temporal_grounding"), "temporal_grounding")
        .when((t == "aggregation") | t.endswith("_aggregation"), "aggregation")
        .when(t.contains("event_understanding") | t.contains("event_and_procedural_understanding"), "event_understanding")
        .when(t.contains("complex_reasoning"), "complex_reasoning")
    )
    if not strict:
        return known
    return F.when(known.isNotNull() | blank(text), known).otherwise(F.raise_error(F.concat(F.lit("unknown capability group: "), text)))


def joined_codes(codes: Column) -> Column:
    return F.coalesce(F.array_join(codes, ";"), F.lit(""))
