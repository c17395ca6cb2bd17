"""The surface to a language model: chunks, prompts, the generation hook, and reading facts out of its answers."""

from __future__ import annotations

import json
import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import r6

MAX_CHARS, OVERLAP = 2000, 150
CONTEXT = 20  # summaries of earlier passes that a prompt may hold
Generate = Callable[[str, int], str]

FACT_SCHEMA = "array<struct<source:string, source_quote:string, date:string, location:string, people:array<string>, summary:string, category:string, identified_crime:string, severity:int, confidence:float>>"


def chunks(texts: DataFrame, id_col: str, name_col: str, text_col: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(id, chunk_no, label, chunk): the text in steps of max_chars - overlap signs up to the first chunk that reaches its end. Later chunks are labelled as parts."""
    step = max_chars - overlap
    if step < 1:
        raise ValueError("overlap must be less than max_chars")
    n = F.length(text_col)
    last = F.when(n <= max_chars, F.lit(0)).otherwise(F.ceil((n - max_chars) / F.lit(step)).cast("int"))
    t = texts.filter(F.col(text_col).isNotNull() & (F.col(text_col) != "")).select(F.col(id_col).alias("id"), F.col(name_col).alias("name"), F.col(text_col).alias("text"), last.alias("last"))
    e = t.select("id", "name", "text", "last", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("chunk_no"))
    label = F.when(F.col("chunk_no") == 0, F.col("name")).otherwise(F.format_string("%s (Part %d/%d)", F.coalesce("name", F.lit("")), F.col("chunk_no") + 1, F.col("last") + 1))
    return e.select("id", "chunk_no", label.alias("label"), F.substring("text", F.col("chunk_no") * step + 1, F.lit(max_chars)).alias("chunk"))


def model_family(name: Column) -> Column:
    """The prompt family of a model file."""
    low = F.lower(name)
    return F.when(low.contains("gemma-3") | low.contains("gemma3"), "Gemma3").when(low.contains("mistral"), "Mistral").when(low.contains("llama-2") | low.contains("llama2"), "Llama2").otherwise("ChatML")


SYSTEM = "Extract the facts of the text as a JSON array of objects with the fields source_quote, date, location, people, summary, category, identified_crime, severity (1 to 10) and confidence (0 to 1)."


def prompt(family: Column, label: Column, chunk: Column, system: str = SYSTEM) -> Column:
    """The prompt for a chunk in the form of a model family."""
    user = F.concat(F.lit("Source: "), F.coalesce(label, F.lit("")), F.lit("\n\n"), chunk)
    gemma = F.concat(F.lit(f"<start_of_turn>user\n{system}\n\n"), user, F.lit("<end_of_turn>\n<start_of_turn>model\n"))
    inst = F.concat(F.lit(f"[INST] {system}\n\n"), user, F.lit(" [/INST]"))
    chat = F.concat(F.lit(f"<|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n"), user, F.lit("<|im_end|>\n<|im_start|>assistant\n"))
    return F.when(family == "Gemma3", gemma).when(family.isin("Mistral", "Llama2"), inst).otherwise(chat)


def generate(prompts: DataFrame, model: Generate, max_tokens: int = 256) -> DataFrame:
    """(id, chunk_no, label, output, error) by a callable that each worker gets; a failing prompt becomes a row with an error."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, err = [], []
            for p in b.column("prompt").to_pylist():
                try:
                    out.append(model(p, max_tokens))
                    err.append(None)
                except Exception as e:
                    out.append(None)
                    err.append(str(e))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("chunk_no"), b.column("label"), pa.array(out, pa.string()), pa.array(err, pa.string())], names=["id", "chunk_no", "label", "output", "error"])

    kind = prompts.schema["id"].dataType.simpleString()
    return prompts.select("id", "chunk_no", "label", "prompt").mapInArrow(scan, f"id {kind}, chunk_no int, label string, output string, error string")


def json_objects(text: str | None) -> list[dict]:
    """All JSON objects of a text, in order: its elements if it is an array (strings that hold objects count), else those found in it. Braces inside strings don't count; objects inside other brackets do."""
    if not text:
        return []
    try:
        whole = json.loads(text)
    except ValueError:
        whole = None
    if isinstance(whole, dict):
        return [whole]
    if isinstance(whole, list):
        out = []
        for x in whole:
            if isinstance(x, str):
                try:
                    x = json.loads(x)
                except ValueError:
                    continue
            if isinstance(x, dict):
                out.append(x)
        return out
    out, at, read = [], text.find("{"), json.JSONDecoder()
    while at >= 0:
        try:
            x, end = read.raw_decode(text, at)
            out.append(x)
            at = text.find("{", end)
        except ValueError:
            at = text.find("{", at + 1)
    return [x for x in out if isinstance(x, dict)]


def fact_objects(output: Column) -> Column:
    """An answer's objects as JSON text, the well-formed arrays being read in the JVM and only others in Python."""

    @F.pandas_udf("string")
    def read(s):  # noqa: ANN001, ANN202
        return s.map(lambda t: json.dumps(json_objects(t), ensure_ascii=False))

    plain = F.from_json(output, "array<string>")
    return F.when(output.isNull(), F.lit("[]")).when(plain.isNotNull() & ~F.exists(F.coalesce(plain, F.array().cast("array<string>")), lambda x: ~x.startswith("{")), output).otherwise(read(output))


def parse_facts(outputs: DataFrame) -> DataFrame:
    """Facts of answers, with defaults for what they leave out: source 'unknown', summary 'No summary', category 'other', severity 1, confidence 0.5."""
    f = outputs.select("id", "chunk_no", "label", F.posexplode(F.from_json(fact_objects(F.col("output")), FACT_SCHEMA)).alias("pos", "f"))
    return f.select(
        "id", "chunk_no", "pos", F.coalesce("f.source", "label", F.lit("unknown")).alias("source"), F.coalesce("f.source_quote", F.lit("")).alias("source_quote"), "f.date", "f.location",
        F.coalesce("f.people", F.array().cast("array<string>")).alias("people"), F.coalesce("f.summary", F.lit("No summary")).alias("summary"), F.coalesce("f.category", F.lit("other")).alias("category"), "f.identified_crime",
        F.coalesce("f.severity", F.lit(1)).alias("severity"), F.coalesce("f.confidence", F.lit(0.5)).cast("double").alias("confidence"),
    )


def strict_facts(outputs: DataFrame) -> DataFrame:
    """Facts of answers that are an array or an object with a list of facts; those without a summary are dropped."""
    flat = F.coalesce(F.from_json("output", FACT_SCHEMA), F.from_json("output", f"struct<facts:{FACT_SCHEMA}>")["facts"])
    f = outputs.select("id", F.posexplode(flat).alias("pos", "f")).filter("f.summary is not null")
    return f.select("id", "pos", "f.summary", F.coalesce("f.category", F.lit("other")).alias("category"), F.coalesce("f.confidence", F.lit(0.5)).cast("double").alias("confidence"), F.coalesce("f.source_quote", F.lit("")).alias("source_quote"))


def entity_count(output: Column) -> Column:
    """How many entities an answer lists: under entities, else patterns, else at its top."""
    return F.coalesce(F.json_array_length(F.get_json_object(output, "$.entities")), F.json_array_length(F.get_json_object(output, "$.patterns")), F.json_array_length(output), F.lit(0))


def sample_paragraphs(text: str, size: int, seed: int = 0) -> str:
    """A text of up to `size` bytes as it is, else that many of its paragraphs at most, drawn at random."""
    if len(text.encode()) <= size:
        return text
    paragraphs = [p for p in re.split(r"\n\s*\n", text) if p.strip()]
    keep = sorted(random.Random(seed).sample(range(len(paragraphs)), min(size, len(paragraphs))))
    return "\n\n".join(paragraphs[k] for k in keep)


@dataclass
class Pass:
    name: str
    system: str = SYSTEM
    sample_bytes: int = 20_000


@dataclass
class Pipeline:
    name: str
    passes: list[Pass] = field(default_factory=list)


PIPELINES = {
    "basic_facts": Pipeline("basic_facts", [Pass("facts")]),
    "financial_crimes": Pipeline("financial_crimes", [Pass("transactions", SYSTEM + " Keep to payments, accounts and amounts."), Pass("patterns", SYSTEM + " Keep to patterns of concealment.")]),
}


def sampled(texts: DataFrame, text_col: str, size: int, seed: int = 0) -> DataFrame:
    """texts with each text above `size` bytes replaced by a sample of its paragraphs."""

    @F.pandas_udf("string")
    def draw(s):  # noqa: ANN001, ANN202
        return s.map(lambda t: t if t is None else sample_paragraphs(t, size, seed))

    return texts.withColumn(text_col, F.when(F.octet_length(text_col) > size, draw(text_col)).otherwise(F.col(text_col)))


def write_back(facts: DataFrame, texts: DataFrame, registry: DataFrame, id_col: str, key: str = "fingerprint") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Results of analyse() to be stored: facts with the file they came from, one row with counts, and the registry with the analysed files marked as processed."""
    own = texts.select(F.col(id_col).alias("id"), key).distinct()
    stored = facts.join(own, "id")
    counts = texts.agg(F.countDistinct(id_col).alias("texts")).crossJoin(facts.agg(F.count(F.lit(1)).alias("facts"), F.countDistinct("id").alias("texts_with_facts"), r6(F.avg("severity")).alias("mean_severity")))  # of single rows
    done = registry.join(own.select(key).distinct().withColumn("__done", F.lit(True)), key, "left").withColumn("processed", F.coalesce("processed", F.lit(False)) | F.coalesce("__done", F.lit(False)))
    return stored, counts, done.select(*registry.columns)


def analyse(texts: DataFrame, id_col: str, name_col: str, text_col: str, model: Generate, family: str = "ChatML", system: str = SYSTEM) -> DataFrame:
    """Facts of texts: chunks, prompts, answers, facts, without exact repetitions of source and summary in one text."""
    c = chunks(texts, id_col, name_col, text_col).withColumn("prompt", prompt(F.lit(family), F.col("label"), F.col("chunk"), system))
    return first_of_each(parse_facts(generate(c, model)))


def first_of_each(facts: DataFrame) -> DataFrame:
    """Facts without exact repetitions of source and summary in one text."""
    place = F.struct("chunk_no", "pos")
    cols = [x for x in facts.columns if x not in ("id", "source", "summary")]
    return facts.groupBy("id", "source", "summary").agg(F.min_by(F.struct(*cols), place).alias("r")).select("id", "source", "summary", "r.*")


def run_pipeline(texts: DataFrame, id_col: str, name_col: str, text_col: str, pipeline: Pipeline, model: Generate, family: str = "ChatML") -> DataFrame:
    """All passes of a pipeline over the same texts, with the name of the pass."""
    out = None
    for p in pipeline.passes:
        source = sampled(texts, text_col, p.sample_bytes)
        if "{{CONTEXT}}" in p.system and out is not None:
            # the summaries found so far in a text, the first CONTEXT of them
            rank = F.row_number().over(Window.partitionBy("id").orderBy("chunk_no", "pos", "pass_name"))
            before = out.withColumn("r", rank).filter(F.col("r") <= CONTEXT).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "summary"))), lambda x: x["summary"]), "\n").alias("context"))
            c = chunks(source, id_col, name_col, text_col).join(before, "id", "left")
            c = c.withColumn("prompt", F.replace(prompt(F.lit(family), F.col("label"), F.col("chunk"), p.system), F.lit("{{CONTEXT}}"), F.coalesce("context", F.lit(""))))
            one = first_of_each(parse_facts(generate(c, model)))
        else:
            one = analyse(source, id_col, name_col, text_col, model, family, p.system.replace("{{CONTEXT}}", ""))
        one = one.withColumns({"pipeline_id": F.lit(pipeline.name), "pass_name": F.lit(p.name)})
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("a pipeline has a pass at least")
    return out


#: Some of the commonest words of each language, for guessing it.
COMMON_WORDS = {
    "en": "the of and to in was for that with on", "de": "der die und das für mit wurde nach nicht ist", "fr": "le la les et des une pour dans été est", "es": "el los y por para una fue según con del",
    "pt": "o os e para uma não foi com em da", "pl": "i w na z do nie jest się przez o", "ru": "и в на не что по с из были о", "it": "il e di per una non è con del che",
}


def language(text: Column) -> Column:
    """The language whose common words are most among a text's words; ja for kana, null if none is found."""
    w = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+")

    def score(code: str, common: str) -> Column:
        return F.struct(F.size(F.filter(w, lambda x: x.isin(common.split()))).alias("n"), F.lit(code).alias("code"))

    scores = F.array(*[score(*x) for x in COMMON_WORDS.items()])
    best = F.array_max(scores)
    return F.when(text.rlike(r"[\u3040-\u30ff]"), "ja").when(best["n"] > 0, best["code"])


def derived_entities(facts: DataFrame) -> DataFrame:
    """Entities that facts name: people and places, one row for each fact and value."""
    people = facts.select("id", "fingerprint", F.explode("people").alias("value"), F.lit("person").alias("entity_type"), "confidence")
    places = facts.select("id", "fingerprint", F.col("location").alias("value"), F.lit("location").alias("entity_type"), "confidence")
    both = people.unionByName(places).filter("value is not null").withColumn("value", F.trim("value")).filter("value <> ''")
    return both.select(F.col("id").alias("intelligence_id"), "fingerprint", "entity_type", "value", F.lower("value").alias("normalized_value"), "confidence").distinct()
