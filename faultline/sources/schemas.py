"""The tables of the engine as Spark schemas, and their JSON export."""

from __future__ import annotations

import json

from pyspark.sql import types as T

SOURCE = "struct<page_id:bigint,revision_id:bigint,page_title:string,section_title:string,chunk_id:string>"
SECTION = "struct<section_index:int,section_title:string,section_path:array<string>,level:int,char_start:int,char_end:int,text:string>"
VERIFICATION = "struct<injection_valid:boolean,answer_available:boolean,gold_answer_leaked:boolean,judge_verified:boolean,verification_score:double,failed_checks:array<string>,judge_confidence:double>"

# Columns of the interchange tables.
DDL = {
    "page": f"schema_version string, page_id bigint, revision_id bigint, page_title string, categories array<string>, category_group string, retrieved_at timestamp, source_url string, raw_text string, is_redirect boolean, redirect_target string, is_disambiguation boolean, char_count int, section_count int, cleaned_text string, sections array<{SECTION}>, metadata string",
    "rejected_page": "schema_version string, page_id bigint, page_title string, category_group string, rejection_reasons array<string>, char_count int, metadata string",
    "chunk": "schema_version string, chunk_id string, page_id bigint, revision_id bigint, page_title string, section_path array<string>, section_title string, paragraph_index int, chunk_index int, token_count int, char_start int, char_end int, text string, previous_chunk_id string, next_chunk_id string, category_group string, metadata string",
    "candidate": f"schema_version string, candidate_id string, question string, gold_answer string, supporting_sentence string, answer_type string, difficulty string, reasoning_type string, is_time_sensitive boolean, source {SOURCE}, category_group string, metadata string",
    "validation": "schema_version string, candidate_id string, accepted boolean, quality_score double, rejection_reasons array<string>, answerable boolean, answer_supported boolean, answer_unique boolean, question_clear boolean, baseline_correct boolean, baseline_em double, baseline_f1 double, judge_confidence double",
    "seed": f"schema_version string, sample_id string, question string, gold_answer string, supporting_sentence string, clean_contexts array<string>, answer_type string, difficulty string, reasoning_type string, is_time_sensitive boolean, source {SOURCE}, category_group string, quality_score double",
    "failure": f"schema_version string, failure_id string, parent_seed_id string, failure_type string, stage string, severity string, difficulty double, question string, gold_answer string, supporting_sentence string, contexts array<string>, answer_available boolean, expected_behavior string, source {SOURCE}, category_group string, verification {VERIFICATION}",
    "evaluation": "schema_version string, eval_id string, sample_id string, model_name string, condition string, severity string, prediction string, gold_answer string, exact_match double, token_f1 double, semantic_similarity double, llm_judge_correct boolean, abstained boolean, hallucinated boolean",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[name])


def export() -> dict[str, str]:
    """Each table's schema as JSON text."""
    return {name: json.dumps(schema(name).jsonValue(), indent=2) for name in DDL}
