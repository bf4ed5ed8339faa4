"""Schemas, domains and fixed limits of the document tables."""

from __future__ import annotations

from pyspark.sql import types as T

STATUSES = ("uploading", "registered", "running", "uploaded", "failed", "skipped", "ocr_required")
ROLLBACK_STATUSES = ("uploaded", "failed", "running", "ocr_required", "skipped")
TERMINAL = ("completed", "failed")
EXTENSIONS = ("txt", "pdf", "docx", "xlsx", "xls", "ppt", "pptx", "jpg", "jpeg", "png", "mp3", "mp4")
ADMIN_USER = 1

_s, _l, _d, _b = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


META = _struct(
    id=_l, group_id=_l, user_id=_l, category=_s, title=_s, filename=_s, hash_sha256=_s, file_size=_l, status=_s, role_ids=T.ArrayType(_l),
    start_date=_l, end_date=_l, expiration_date=_l, token=_l, cost=_d, summary_cost=_d,
)
CHUNKS = _struct(
    hash_sha256=_s, page_number=_l, chunk_index=_l, parsed_text=_s, token=_l, cost=_d, role_ids=T.ArrayType(_l), group_id=_l, category=_s, title=_s, filename=_s,
)
UPLOAD_EVENT = T.StructType([
    T.StructField("task_id", _s), T.StructField("file_path", _s), T.StructField("file_size", _l),
    T.StructField("metadata", _struct(
        pipeline_separation=_b, title=_s, filename=_s, file_type=_s, category=_s, expiration_date=_s, chunk_size=_l, chunk_overlap=_l,
        enable_pii_anonymization=_b, pii_strategy=_s, pii_types=T.ArrayType(_s), persona_id=_l, filter_score=_d,
        urls=_struct(stream_url=_s), routing_analysis=_struct(routing_key=_s))),
    T.StructField("user_info", _struct(passport_data=_struct(user_id=_l, groups=T.ArrayType(_l), total_roles=T.ArrayType(_l)))),
])
PROGRESS = _struct(task_id=_s, user_id=_l, hash_sha256=_s, category=_s, stage=_s, status=_s, ts=_l)
RESPONSE = T.StructType([
    T.StructField("entities", T.ArrayType(_struct(name=_s, type=_s))),
    T.StructField("relations", T.ArrayType(_struct(source=_s, type=_s, target=_s))),
])
