"""Boundaries to what is not part of the engine: chunking, embedding, extraction.

Each takes a Python callable and runs it over Arrow batches; replay versions read
recorded results, so a pipeline runs the same without a network.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia import schemas
from evidentia.functions.predicates import is_rate_limit
from evidentia.operators.validate import Extraction
from evidentia.plans.lineage import cut, scratch

#: Texts in a call, tries, and the first pause in seconds, doubled every time.
BATCH, TRIES, PAUSE = 100, 4, 1.5
#: Further calls for a prompt whose answer is no JSON object.
RETRIES = 2


def with_retries(call: Callable, tries: int = TRIES, pause: float = PAUSE, sleep: Callable[[float], None] = time.sleep) -> object:
    """call(), again after a pause if a rate limit stopped it; other errors are raised at once."""
    for n in range(tries):
        try:
            return call()
        except Exception as e:
            if n == tries - 1 or not is_rate_limit(str(e)):
                raise
            sleep(pause * 2**n)
    raise AssertionError("tries must be positive")


def embed(texts: DataFrame, embedder: Callable[[list[str]], list[list[float]]], id_col: str, text_col: str, batch: int = BATCH) -> DataFrame:
    """(id, embedding): unit vectors of the texts, `batch` of them a call."""
    schema = T.StructType([texts.schema[id_col], T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def unit(v: list[float]) -> list[float]:
        norm = sum(x * x for x in v) ** 0.5
        return [x / norm for x in v] if norm else list(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                said = [x or "" for x in part.column(1).to_pylist()]
                made = with_retries(lambda said=said: embedder(said))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([unit(v) for v in made], pa.list_(pa.float64()))], [id_col, "embedding"])

    return texts.select(id_col, text_col).mapInArrow(run, schema)


def build_index(chunks: DataFrame, vectors: DataFrame, path: str) -> DataFrame:
    """The index as a Parquet table of chunks with their vectors; nothing to index is an error."""
    joined = chunks.join(vectors, "chunk_id")
    if joined.isEmpty():
        raise ValueError("no chunks to index")
    joined.write.mode("overwrite").parquet(path)
    return joined.sparkSession.read.parquet(path)


def replay(results: DataFrame) -> Extraction:
    """Recorded extraction results (project_section_key, requirements, product_groups, products, links as arrays) as four tables."""

    def rows(name: str, schema: T.StructType) -> DataFrame:
        each = results.select("project_section_key", F.posexplode(name).alias("ord", "x"))
        have = set(results.schema[name].dataType.elementType.names)
        own = [f for f in schema.fields if f.name not in ("project_section_key", "ord")]
        return each.select("project_section_key", "ord", *((F.col(f"x.{f.name}") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in own))

    return Extraction(rows("requirements", schemas.REQUIREMENT), rows("product_groups", schemas.PRODUCT_GROUP), rows("products", schemas.PRODUCT), rows("links", schemas.LINK))


def answer(call: Callable[[], dict | str], retries: int = RETRIES) -> dict:
    """What an extractor says, as a dict; JSON text is read, and asked for again if it is none."""
    for n in range(retries + 1):
        made = call()
        if isinstance(made, dict):
            return made
        try:
            read = json.loads(made)
        except (TypeError, ValueError):
            read = None
        if isinstance(read, dict):
            return read
        if n == retries:
            raise ValueError(f"no JSON object after {retries + 1} calls")
    raise AssertionError("retries must not be negative")


#: Prompts whose answers are written together: what a stopped run may have to ask again, for each model.
TOGETHER = 1000
ANSWERS = "prompt_hash string, model string, answer string"


def _known(spark: SparkSession, path: str, model: str) -> DataFrame:
    """(prompt_hash, answer) of a model in the table at path, one for each prompt."""
    try:
        there = spark.read.schema(ANSWERS).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # the first run makes the table
            raise
        there = spark.createDataFrame([], ANSWERS)
    return there.where(F.col("model") == model).groupBy("prompt_hash").agg(F.min("answer").alias("answer"))


def ask(prompts: DataFrame, extractor: Callable[[str], dict | str], answers: str, model: str, together: int = TOGETHER) -> int:
    """Ask for the prompts whose answers by `model`, a name with its version, are not in the table at `answers`; gives how many.

    Prompts are known by their content, so equal ones are asked once, under
    whatever key, and in whatever run.  Answers are added to the table about
    `together` prompts at a time: a run that was stopped goes on where it was.
    """
    spark = prompts.sparkSession
    wanted = prompts.select(F.sha2("prompt", 256).alias("prompt_hash"), "prompt").where("prompt is not null").dropDuplicates(["prompt_hash"])
    missing = cut(wanted.join(_known(spark, answers, model), "prompt_hash", "left_anti"))
    count = missing.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, prompt in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                made = answer(lambda prompt=prompt: with_retries(lambda: extractor(prompt)))
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([model]), pa.array([json.dumps(made)])], ["prompt_hash", "model", "answer"])

    groups = -(-count // together)
    for g in range(groups):
        part = missing.where(F.pmod(F.xxhash64("prompt_hash"), F.lit(groups)) == g)
        part.mapInArrow(run, ANSWERS).write.mode("append").parquet(answers)
    return count


def extract(prompts: DataFrame, extractor: Callable[[str], dict | str], answers: str | None = None, model: str = "model") -> Extraction:
    """extractor(prompt) for each (project_section_key, prompt): a dict of four lists, or its JSON.

    The answers are stored before they are taken apart, so that all four tables
    come from one call for each prompt: in the table at `answers` (see ask()),
    which later runs use again, or in one of this run's own.  Settings of a model,
    such as its temperature, are the extractor's own, and belong in its name.
    """
    spark = prompts.sparkSession
    path = answers or scratch(spark, "answers")
    ask(prompts, extractor, path, model)
    parts = {"requirements": schemas.REQUIREMENT, "product_groups": schemas.PRODUCT_GROUP, "products": schemas.PRODUCT, "links": schemas.LINK}
    kind = T.StructType([T.StructField(k, T.ArrayType(T.StructType([f for f in s.fields if f.name not in ("project_section_key", "ord")]))) for k, s in parts.items()])
    met = prompts.select("project_section_key", F.sha2("prompt", 256).alias("prompt_hash")).join(_known(spark, path, model), "prompt_hash")
    read = met.select("project_section_key", F.from_json("answer", kind).alias("x"))
    return replay(read.select("project_section_key", *(F.coalesce(f"x.{k}", F.array()).alias(k) for k in parts)))


def prompts(sections: DataFrame, region: DataFrame, candidates: DataFrame, system: str = "") -> DataFrame:
    """(project_section_key, prompt, n_chars): sections with the evidence blocks of their regions and candidates.

    n_chars counts the extractor's system prompt too.
    """
    from evidentia.functions.text import prompt_block

    def block(df: DataFrame, name: str) -> DataFrame:
        one = prompt_block("id", "page_number", "source_clause", "heading_path", "raw_text")
        held = F.array_sort(F.collect_list(F.struct("pos", one.alias("b"))))
        return df.groupBy("project_section_key").agg(F.array_join(F.transform(held, lambda x: x["b"]), "\n\n----\n\n").alias(name))

    told = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("(unknown)"))
    rows = sections.join(block(region, "a"), "project_section_key", "left").join(block(candidates, "b"), "project_section_key", "left")
    text = F.concat(
        F.lit("SECTION METADATA\n\nsection_number: "), told("section_number"), F.lit("\nsection_title: "), told("section_title"), F.lit("\n\nSUBMITTAL EVIDENCE\n\n"), F.coalesce("a", F.lit("(none)")),
        F.lit("\n\nPRODUCT EVIDENCE\n\n"), F.coalesce("b", F.lit("(none)")), F.lit("\n"),
    )
    return rows.select("project_section_key", text.alias("prompt")).withColumn("n_chars", F.length("prompt") + len(system))
