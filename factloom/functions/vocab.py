"""The closed type vocabulary, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import strip

# The type vocabulary, its aliases and the wildcard tokens.
EXTRACTION_TYPES = [
    "ACTIVITY", "BODY_PART", "CHEMICALS", "DISCRIMINATIVES", "DISEASE_DISORDER", "DRUGS", "BIO_MARKER",
    "FOOD", "GENES", "HEALTH_PROCEDURES", "SIGN_OR_SYMPTOM", "RISK_FACTOR", "NONE",
]
TYPE_ALIASES = {
    "DIISEASE_DISORDER": "DISEASE_DISORDER",
    "DISEASE-DISORDER": "DISEASE_DISORDER",
    "DISEASE": "DISEASE_DISORDER",
    "CHEMICAL": "CHEMICALS",
    "DRUG": "DRUGS",
    "GENE": "GENES",
    "BIOMARKER": "BIO_MARKER",
    "SYMPTOM": "SIGN_OR_SYMPTOM",
    "SIGN": "SIGN_OR_SYMPTOM",
    "HEALTH_PROCEDURE": "HEALTH_PROCEDURES",
    "CELL_LINE": "BODY_PART",
}
WILDCARDS = ["", "?", "-", "_", "*", "??", "any", "anything"]

QUERY_TYPES = EXTRACTION_TYPES[:-1]


def normalize_type(raw: Column) -> Column:
    """The vocabulary's spelling of a type; NONE for what is null, blank or unknown."""
    t = F.replace(F.upper(strip(F.coalesce(raw, F.lit("")))), F.lit(" "), F.lit("_"))
    aliases = F.create_map(*[F.lit(x) for kv in TYPE_ALIASES.items() for x in kv])
    t = F.coalesce(F.try_element_at(aliases, t), t)
    return F.when(t.isin(EXTRACTION_TYPES), t).otherwise("NONE")


def slot_kind(slot: Column) -> Column:
    """? for a wildcard, T for a query type (case matters, NONE is none), c for anything else."""
    s = strip(slot)
    return F.when(s.isin(WILDCARDS), "?").when(s.isin(QUERY_TYPES), "T").otherwise("c")
