"""Column functions of ids, features and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The feature vocabulary and its spellings.
FEATURES = {"fa": "FA", "adc": "ADC", "thickness": "thickness", "flair": "FLAIR", "qt1": "qT1", "t1map": "qT1", "fmri": "fMRI"}
BLUR = "*blur"
SERIES_FEATURES = ("rmssd", "timescales", "alff", "falff")
STRUCTURES = ("cortex", "hippocampus", "subcortical")
ENTITIES = ("sub", "ses", "hemi", "surf", "den", "label", "feature", "smooth", "analysis")


def canonical_feature(feature: Column) -> Column:
    """The vocabulary's spelling whatever the case, with or without the blur suffix; unknown tokens stay as they are."""
    names = F.create_map(*[F.lit(x) for pair in FEATURES.items() for x in pair])
    low = F.lower(feature)
    blurred = low.endswith(BLUR)
    stem = F.when(blurred, F.regexp_replace(low, r"\*blur$", "")).otherwise(low)
    name = F.element_at(names, stem)
    return F.coalesce(F.when(blurred, F.concat(name, F.lit(BLUR))).otherwise(name), feature)


def for_structure(feature: Column, structure: Column) -> Column:
    """Thickness is volume in subcortical structures."""
    return F.when((feature == "thickness") & structure.isin("subcortical", "subcortex"), F.lit("volume")).otherwise(feature)


def applicable(feature: Column, structure: Column, label: Column) -> Column:
    """Blur and time-series features are cortical and measured on the middle surface only."""
    special = feature.endswith(BLUR) | feature.isin("fMRI", *SERIES_FEATURES)
    return ~special | ((structure == "cortex") & (label == "midthickness"))


def without_prefix(value: Column, prefix: str) -> Column:
    return F.regexp_replace(F.trim(value), f"^{prefix}", "")


def participant(value: Column) -> Column:
    return F.concat(F.lit("sub-"), without_prefix(value, "sub-"))


def session(value: Column) -> Column:
    """ses-<x>; null for null, empty and n/a."""
    bare = without_prefix(value, "ses-")
    return F.when(bare.isNull() | (bare == "") | F.lower(bare).isin("n/a", "nan", "none"), F.lit(None).cast("string")).otherwise(F.concat(F.lit("ses-"), bare))


def bids_id(participant_id: Column, session_id: Column) -> Column:
    return F.concat_ws("_", participant(participant_id), session(session_id))


def valid_id(participant_id: Column, session_id: Column) -> Column:
    return participant_id.rlike("^sub-.+") & (session_id.isNull() | session_id.rlike("^ses-.+"))


def entity(path: Column, name: str) -> Column:
    """The value of `name-<value>` in a file name; null if absent."""
    found = F.regexp_extract(path, rf"(?:^|[/_]){name}-([^_/.]+)", 1)
    return F.when(found != "", found)


def map_path(**entities: Column) -> Column:
    """A file name of entities in the given order."""
    return F.concat_ws("_", *[F.concat(F.lit(f"{k}-"), v) for k, v in entities.items()])


def report_date(when: Column) -> Column:
    """A date as reports print it: January 31, 2024."""
    return F.date_format(when, "MMMM dd, yyyy")
