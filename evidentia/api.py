"""The public names of the engine, as its users call them.

Tables take the place of lists of objects: what names a record is the schema of its
table, what names an enumeration its values, and functions take and give DataFrames.
"""

from __future__ import annotations

from evidentia import schemas
from evidentia.operators import candidates, evidence, export, packaging, present, project, regions, sections, validate
from evidentia.functions import text
from evidentia.plans import register
from evidentia.sources import plugins

# records
BBox = schemas.BBOX
SourceEvidence = schemas.EVIDENCE
SubmittalRequirement = schemas.REQUIREMENT
ProductGroup = schemas.PRODUCT_GROUP
Product = schemas.PRODUCT
RequirementProductLink = schemas.LINK
ValidationIssue = schemas.ISSUE
ProjectSpecSection = schemas.SECTION
SpecSection = schemas.SPEC_SECTION
SubmittalRegion = schemas.REGION
ProductCandidateRegion = schemas.CANDIDATE
ProductCandidateCollection = schemas.CANDIDATE_TOTALS
SectionCoverageReport = schemas.COVERAGE
ProjectSpecDocument = schemas.DOCUMENT
ProductView = schemas.PRODUCT_VIEW
ProductGroupView = schemas.GROUP_VIEW
RequirementView = schemas.REQUIREMENT_VIEW
SectionSubmittalView = schemas.SECTION_VIEW
ProjectRegisterRow = schemas.REGISTER_ROW
ProjectSubmittalView = schemas.PROJECT_VIEW
DraftSubmittalRow = schemas.DRAFT
ExportSubmittalRow = schemas.EXPORT_ROW
ProjectExportSummary = schemas.EXPORT_SUMMARY
EvidenceHighlight = schemas.HIGHLIGHT
SourceReviewSelection = schemas.REVIEW
# values
EvidenceKind = schemas.EVIDENCE_KINDS
IssueSeverity = schemas.SEVERITIES
MappingMethod = schemas.MAPPING_METHODS
PackagingMode = schemas.PACKAGING_MODES
ProcessingStatus = schemas.STATUSES
ReviewStatus = schemas.REVIEW_STATUSES
SubmittalType = schemas.SUBMITTAL_TYPES
UNGROUPED_GROUP_ID, UNGROUPED_GROUP_NAME = present.UNGROUPED_ID, present.UNGROUPED_NAME
# groups of tables
SubmittalExtractionResult = ValidatedExtraction = validate.Extraction
ValidationReport = validate.Validated
ProjectExportBundle = export.Bundle
SubmittalPipelineResult = register.Run
SubmittalPipelineError = ValueError
# strategies
Part2ProductCandidateStrategy = candidates.part_products
HeadingFallbackProductCandidateStrategy = candidates.heading_fallback
# functions
build_draft_submittals = packaging.drafts
build_project_documents_from_docling = project.build
build_project_export = export.build
build_project_submittal_view = project.register
build_section_submittal_view = present.section_view
build_source_review_selection = evidence.review_selection
can_export_project = project.can_export
check_section_view_consistency = present.consistency
collect_product_candidate_evidence = candidates.collect
discover_spec_sections = sections.discover
export_excel_bytes = export.workbook
export_markdown = export.markdown
extract_submittals = plugins.extract
get_region_evidence = regions.region_evidence
locate_submittal_regions = regions.locate
make_document_id = project.document_id
make_draft_id = packaging.draft_id
make_project_section_key = project.section_key
make_section_id = sections.section_id
merge_draft_rows = packaging.merge
normalize_section_number = text.section_number
resolve_evidence = evidence.resolve
resolve_scope_evidence = evidence.scope
run_submittal_extraction = register.run_sections
sanitize_export_basename = text.export_basename
section_coverage_report = sections.coverage
validate_extraction = validate.validate


def export_markdown_bytes(bundle: export.Bundle) -> bytes:
    return export.markdown(bundle).encode()


def prompt_character_count(*parts: object, **options: object) -> object:
    """(project_section_key, n_chars) of plugins.prompts()."""
    return plugins.prompts(*parts, **options).select("project_section_key", "n_chars")


__all__ = sorted(n for n in dir() if not n.startswith("_") and n not in ("annotations", "schemas", "candidates", "evidence", "export", "packaging", "present", "project", "regions", "sections", "validate", "text", "register", "plugins"))
