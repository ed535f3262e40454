"""Declared schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
_IDS = T.ArrayType(_S)


def _of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


BBOX = _of(l=_D, t=_D, r=_D, b=_D, coord_origin=_S)
ITEM = _of(document_id=_S, pos=_I, self_ref=_S, label=_S, orig=_S, text=_S, marker=_S, prov=T.ArrayType(_of(page_no=_I, bbox=BBOX)))
_REF = T.StructType([T.StructField("$ref", _S)])
_NODE = _of(self_ref=_S, parent=_REF, children=T.ArrayType(_REF), content_layer=_S, label=_S)
_PLACED = T.StructType([*_NODE.fields, T.StructField("prov", T.ArrayType(_of(page_no=_I, bbox=BBOX)))])
_TEXT = T.StructType([*_PLACED.fields, *_of(orig=_S, text=_S, marker=_S).fields])
#: The parsed document that a parser caches: parts in flat arrays, the body and groups with references to them.
PARSED = _of(
    name=_S, body=_NODE, groups=T.ArrayType(_NODE), texts=T.ArrayType(_TEXT), pictures=T.ArrayType(_PLACED), tables=T.ArrayType(_PLACED),
    key_value_items=T.ArrayType(_PLACED), form_items=T.ArrayType(_PLACED),
)
EVIDENCE = _of(
    id=_S, document_id=_S, spec_section_id=_S, docling_ref=_S, page_number=_I, bbox=BBOX, raw_text=_S, text_hash=_S,
    heading_path=_IDS, source_clause=_S, evidence_kind=_S, chunk_id=_I, contextualized_text=_S, pos=_I,
)
REQUIREMENT = _of(
    project_section_key=_S, ord=_I, id=_S, spec_section_id=_S, source_category=_S, submittal_type=_S, title=_S, requirement_text=_S,
    condition=_S, cross_references=_IDS, source_clause=_S, evidence_ids=_IDS, review_status=_S,
)
PRODUCT_GROUP = _of(project_section_key=_S, ord=_I, id=_S, spec_section_id=_S, code=_S, name=_S, parent_group_id=_S, evidence_ids=_IDS, review_status=_S)
PRODUCT = _of(
    project_section_key=_S, ord=_I, id=_S, spec_section_id=_S, name=_S, normalized_name=_S, product_group_id=_S, description=_S,
    evidence_ids=_IDS, review_status=_S,
)
LINK = _of(
    project_section_key=_S, ord=_I, id=_S, requirement_id=_S, product_id=_S, mapping_method=_S, evidence_ids=_IDS, source_phrase=_S,
    confidence=_D, review_required=_B, review_status=_S,
)
ISSUE = _of(project_section_key=_S, severity=_S, entity_type=_S, entity_id=_S, code=_S, message=_S, evidence_ids=_IDS, phase=_I, ord=_I, rule=_I, item=_I)
SECTION = _of(key=_S, document_id=_S, filename=_S, section_id=_S, section_number=_S, section_title=_S, start_page=_I, end_page=_I, evidence_count=_L)
CHUNK = _of(
    page_content=_S, filename=_S, source=_S, file_type=_S, chunk_id=_I, raw_text=_S, supporting_context=_S, headings=_S, labels=_S,
    was_enriched=_B, contextualized_preview=_S, page=_I,
)
SPEC_SECTION = _of(
    id=_S, document_id=_S, section_number=_S, title=_S, start_evidence_id=_S, end_evidence_id=_S, evidence_ids=_IDS, start_page=_I, end_page=_I,
    heading_evidence_ids=_IDS, division_number=_S, division_title=_S, detection_method=_S, warnings=_IDS, start_index=_I, end_index=_I,
)
REGION = _of(
    document_id=_S, start_index=_I, end_index=_I, start_evidence_id=_S, heading=_S, source_clause=_S, priority=_I, detection_method=_S,
    warnings=_IDS, evidence_ids=_IDS, end_evidence_id=_S,
)
CANDIDATE = _of(document_id=_S, heading_evidence_id=_S, heading=_S, source_clause=_S, evidence_ids=_IDS, start_index=_I, end_index=_I, chars=_L, detection_method=_S)
CANDIDATE_TOTALS = _of(document_id=_S, total_regions=_L, total_evidence=_L, approx_char_count=_L)
COVERAGE = _of(
    document_id=_S, total_evidence=_L, assigned_evidence=_L, evidence_before_first_section=_L, evidence_unassigned=_L,
    unassigned_evidence_ids=_IDS, duplicate_assignment_ids=_IDS,
)
DOCUMENT = _of(document_id=_S, filename=_S, content=T.BinaryType(), items=T.ArrayType(_of(**{f.name: f.dataType for f in ITEM.fields[2:]})))
PRODUCT_VIEW = _of(
    product_ord=_I, product_id=_S, name=_S, normalized_name=_S, group_id=_S, group_name=_S, evidence_ids=_IDS, suggested_for_requirement=_B,
    mapping_method=_S, review_required=_B, confidence=_D,
)
GROUP_VIEW = _of(place=_I, group_id=_S, name=_S, code=_S, evidence_ids=_IDS, products=T.ArrayType(PRODUCT_VIEW), total_products=_L, suggested_products=_L)
REQUIREMENT_VIEW = T.StructType([
    *(T.StructField("requirement_id" if f.name == "id" else f.name, f.dataType) for f in REQUIREMENT.fields),
    *_of(product_groups=T.ArrayType(GROUP_VIEW), suggested_product_ids=_IDS, available_product_count=_L, suggested_product_count=_I).fields,
])
SECTION_VIEW = T.ArrayType(REQUIREMENT_VIEW)
REGISTER_ROW = _of(
    project_section_key=_S, document_id=_S, filename=_S, section_number=_S, section_title=_S, requirement_id=_S, submittal_type=_S, title=_S,
    source_clause=_S, available_product_count=_L, suggested_product_count=_I, confirmed_product_count=_I,
)
PROJECT_VIEW = T.ArrayType(REGISTER_ROW)
DRAFT = _of(
    id=_S, requirement_id=_S, spec_section_id=_S, project_section_key=_S, source_clause=_S, submittal_type=_S, title=_S, product_ids=_IDS,
    product_names=_IDS, requirement_evidence_ids=_IDS, packaging_mode=_S, item=_I,
)
EXPORT_ROW = _of(
    source_file=_S, spec_section=_S, spec_title=_S, source_clause=_S, submittal_type=_S, submittal_title=_S, products=_IDS, product_count=_I,
    products_status=_S, row_kind=_S, requirement_id=_S, draft_id=_S, project_section_key=_S,
)
EXPORT_SUMMARY = _of(
    uploaded_file_count=_L, detected_section_count=_L, processed_section_count=_L, completed_count=_L, no_submittals_count=_L, failed_count=_L,
    not_processed_count=_L, exported_register_row_count=_L,
)
HIGHLIGHT = _of(evidence_id=_S, page_number=_I, bbox=BBOX, raw_text=_S, source_clause=_S, heading_path=_IDS, missing=_B)
REVIEW = _of(entity_type=_S, entity_id=_S, title=_S, evidence_ids=_IDS, highlights=T.ArrayType(HIGHLIGHT), missing_evidence_ids=_IDS)

# Values of the enumerated columns (fixed values).
MAPPING_METHODS = ("explicit", "normalized", "inferred")
EVIDENCE_KINDS = ("requirement", "product", "product_group", "heading", "cross_reference", "other")
STATUSES = ("not_processed", "processing", "completed", "no_submittals", "failed")
SEVERITIES = ("error", "warning")
PACKAGING_MODES = ("combined", "one_per_product")
REVIEW_STATUSES = ("pending", "accepted", "edited", "rejected")
SUBMITTAL_TYPES = (
    "product_data", "shop_drawings", "sample", "certification", "test_report", "quality_control", "operation_and_maintenance",
    "closeout", "warranty", "other",
)
