"""Explicit schemas: no reader in this package infers one."""

from __future__ import annotations

# Parquet tables the driver provides. Timestamps carry no zone in the files.
TABLES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
                "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}

# Study tables of the application.
STUDY_TABLES = {
    "users": "id STRING, email STRING, created_at TIMESTAMP, last_login TIMESTAMP, is_active BOOLEAN, email_verified BOOLEAN",
    "subjects": "id STRING, user_id STRING, name STRING, description STRING, color STRING, icon STRING, created_at TIMESTAMP",
    "chapters": "id STRING, subject_id STRING, name STRING, order_index INT, created_at TIMESTAMP",
    "notes": "id STRING, user_id STRING, subject_id STRING, chapter_id STRING, title STRING, ocr_text STRING, "
             "parsed_content STRING, summary_brief STRING, summary_detailed STRING, processing_status STRING, "
             "error_message STRING, created_at TIMESTAMP",
    "flashcards": "id STRING, note_id STRING, user_id STRING, question STRING, answer STRING, difficulty INT, "
                  "interval INT, repetitions INT, ef DOUBLE, next_review_date DATE",
    "study_sessions": "id STRING, user_id STRING, flashcard_id STRING, quality INT, time_spent_seconds INT, reviewed_at TIMESTAMP",
    "knowledge_graph_nodes": "id STRING, user_id STRING, note_id STRING, node_type STRING, node_label STRING, "
                             "external_id STRING, properties STRING",
}

# Parsed note content; the second name of each pair is the alternate key seen in the wild.
PARSED_CONTENT = (
    "topics ARRAY<STRUCT<name STRING, title STRING, description STRING, "
    "subtopics ARRAY<STRUCT<name STRING, title STRING, content STRING, key_points ARRAY<STRING>>>>>, "
    "formulas ARRAY<STRUCT<latex STRING, expression STRING, description STRING, variables ARRAY<STRING>>>, "
    "key_concepts ARRAY<STRUCT<name STRING, label STRING, definition STRING, examples ARRAY<STRING>>>, "
    "questions ARRAY<STRUCT<question STRING, q STRING, answer STRING, a STRING, difficulty STRING, "
    "difficulty_label STRING, context STRING, topic STRING>>, "
    "metadata STRUCT<word_count INT, estimated_reading_time_minutes DOUBLE, academic_level STRING>"
)

QUIZ_CONTENT = (
    "questions ARRAY<STRUCT<question STRING, type STRING, correct_answer STRING, explanation STRING, "
    "difficulty STRING, points INT>>"
)

# Structured service log lines: one schema per event name.
LOG_EVENTS = {
    "http_request": "request_id STRING, method STRING, path STRING, status_code INT, duration_ms DOUBLE, ip STRING",
    "llm_call": "request_id STRING, model STRING, op STRING, prompt_tokens INT, completion_tokens INT, duration_ms DOUBLE, cost DOUBLE",
    "ocr_result": "request_id STRING, image_size_mb DOUBLE, text_length INT, confidence DOUBLE, duration_ms DOUBLE",
    "ocr_fallback_chain": "task_id STRING, chain ARRAY<STRING>, final_service STRING, final_confidence DOUBLE",
    "summarization": "request_id STRING, mode STRING, brief_word_count INT, detailed_word_count INT, duration_ms DOUBLE, cache_hit BOOLEAN, cost DOUBLE",
    "flashcard_generation": "request_id STRING, flashcard_count INT, source_counts MAP<STRING, INT>, duration_ms DOUBLE, cache_hit BOOLEAN, cost DOUBLE",
    "quiz_generation": "request_id STRING, question_count INT, question_types ARRAY<STRING>, duration_ms DOUBLE, cost DOUBLE",
    "mindmap_generation": "request_id STRING, node_count INT, edge_count INT, duration_ms DOUBLE, cost DOUBLE",
}
