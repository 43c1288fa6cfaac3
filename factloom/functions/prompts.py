"""Prompts as configuration: every text can be replaced by the caller."""

from __future__ import annotations

from dataclasses import dataclass, field

from factloom.functions.vocab import EXTRACTION_TYPES, QUERY_TYPES

_SLOTS = ("e1", "e1_type", "verb", "e2", "e2_type")


def triplet_tool() -> dict:
    """What the extraction stage forces a model to fill in."""
    kinds = {k: {"type": "string", "enum": list(EXTRACTION_TYPES)} if k.endswith("_type") else {"type": "string"} for k in _SLOTS}
    item = {"type": "object", "properties": kinds, "required": list(_SLOTS)}
    return {"type": "function", "function": {"name": "save_triplets", "description": "Stores the relations of a text.", "parameters": {"type": "object", "properties": {"triplets": {"type": "array", "items": item}}, "required": ["triplets"]}}}


@dataclass(frozen=True)
class Prompts:
    pronouns: str = "Put the noun that each pronoun stands for in its place. Change nothing else, and return the whole text."
    references: str = "Replace phrases such as 'this drug' or 'the former' by what they refer to. Change nothing else, and return the whole text."
    flatten: str | None = None
    relations: str = f"Give each relation of the text as two short entities with their types and a verb phrase between them. Types: {', '.join(EXTRACTION_TYPES)}."
    patterns: str = "Turn the question into lines MEM( head ^ relation ^ tail ). Leave unknown parts as ?."
    typed_patterns: str = f"Turn the question into lines MEM( head ^ relation ^ tail ). Name a type where a part is asked for ({', '.join(QUERY_TYPES)}), and ? where it may be anything."
    tool: dict = field(default_factory=triplet_tool)
