"""Whole runs: from evidence of sections to validated entities and their views."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators import candidates, present, regions, validate
from evidentia.plans.lineage import cut
from evidentia.sources import plugins

Extractor = Callable[[str], dict]


class Run(NamedTuple):
    regions: DataFrame
    candidates: DataFrame
    validated: validate.Validated
    report: DataFrame
    views: DataFrame
    warnings: DataFrame


class NoEvidence(ValueError):
    """There is nothing to run on."""

    code = "no_source_evidence"


def section_evidence(sections: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence of sections (key, document_id, evidence_ids) with project_section_key; a section is a document to what follows."""
    named = sections.select(F.col("key").alias("project_section_key"), "section_number", "title", F.col("document_id").alias("_d"), F.explode("evidence_ids").alias("_id")).distinct()
    joined = evidence.join(named, (F.col("document_id") == F.col("_d")) & (F.col("id") == F.col("_id"))).drop("_d", "_id")
    return joined.withColumn("document_id", F.col("project_section_key"))


def run_sections(evidence: DataFrame, extractor: Extractor, unicode: bool = True) -> Run:
    """All sections of section_evidence() at once.

    A section without a submittal region goes to no extractor: it has an empty
    result and a warning.
    """
    evidence = cut(evidence)
    if evidence.isEmpty():
        raise NoEvidence("the evidence catalog is empty")
    key = F.col("document_id").alias("project_section_key")
    found = cut(regions.locate(evidence, unicode))
    inside = found.select("document_id", F.explode("evidence_ids").alias("id")).distinct()
    spans = cut(candidates.collect(evidence, inside, unicode=unicode))
    asked = evidence.join(inside, ["document_id", "id"], "left_semi")
    offered = evidence.join(spans.select("document_id", F.explode("evidence_ids").alias("id")).distinct(), ["document_id", "id"], "left_semi")
    sections = evidence.select("project_section_key", "section_number", F.col("title").alias("section_title")).distinct()
    open_ = sections.join(found.select(key).distinct(), "project_section_key", "left_semi")
    prompts = plugins.prompts(open_, asked, offered)
    extraction = validate.Extraction(*map(cut, plugins.extract(prompts, extractor)))
    checked = validate.validate(extraction, evidence, unicode)
    none = sections.join(open_, "project_section_key", "left_anti").select("project_section_key", F.lit("no_submittal_regions_found").alias("warning"))
    more = candidates.warnings(evidence, spans).select(key, F.explode("warnings").alias("warning"))
    return Run(found, spans, checked, validate.report(checked, sections), present.section_view(checked.extraction, evidence), none.unionByName(more))
