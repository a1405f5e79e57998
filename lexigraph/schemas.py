"""Schemas of the stored tables, as plain Python (no session is needed to import them)."""

from pyspark.sql import types as T

_S, _D, _I, _L, _B, _TS = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampNTZType()
_VECTOR, _STRINGS = T.ArrayType(T.FloatType()), T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


SCHEMAS = {
    "skills": _struct(id=_S, external_id=_S, canonical_name=_S, slug=_S, description=_S, status=_S, category=_S, path=_S, version=_I,
                      source=_S, created_at=_TS, updated_at=_TS, metadata=_S, embedding=_VECTOR),
    "aliases": _struct(id=_S, skill_id=_S, surface_form=_S, locale=_S, source=_S, is_primary=_B, created_at=_TS, embedding=_VECTOR),
    "edges": _struct(id=_S, source_skill_id=_S, target_skill_id=_S, relationship_type=_S, confidence=_D, status=_S, provenance=_S,
                     weight=_D, metadata=_S, created_at=_TS, updated_at=_TS),
    "co_occurrences": _struct(skill_a_id=_S, skill_b_id=_S, co_occurrence_count=_L, source_type_counts=T.MapType(_S, _L),
                              last_seen_at=_TS, created_at=_TS),
    "locales": _struct(locale=_S, display_name=_S, is_active=_B, coverage_pct=_D),
    "changelog": _struct(graph_version=_L, ts=_TS, actor=_S, mutation_type=_S, entity_type=_S, entity_id=_S, diff_payload=_S),
    "queue": _struct(queue_id=_S, candidate_name=_S, normalized_name=_S, category_guess=_S, signals_count=_L, llm_score=_D,
                     similar_existing=_STRINGS, suggested_parents=_STRINGS, status=_S, decision=_S, notes=_S, created_at=_TS),
    "extraction_logs": _struct(document_hash=_S, source_type=_S, input_text_preview=_S,
                               discovered_candidates=T.ArrayType(_struct(surface_form=_S, normalized_form=_S)),
                               extracted_skill_ids=_STRINGS, created_at=_TS),
}

# One model answer per chunk.
RESPONSE = _struct(
    extracted_skills=T.ArrayType(_struct(skill_id=_S, skill_name=_S, confidence=_D, evidence=_STRINGS, proficiency_hint=_S,
                                         context_type=_S, section=_S)),
    discovered_candidates=T.ArrayType(_struct(surface_form=_S, suggested_category=_S, reason=_S)), _corrupt=_S)
