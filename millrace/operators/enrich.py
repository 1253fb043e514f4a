"""Enrichment of chunks: policy, validation of a model's output, embedding input, processing hash."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Enrichment
from ..functions.text import clean_strings, kept_if, normalize_whitespace_ends, once
from .batches import small_batches
from .models import with_deadline, with_retries

VERSION = "meta-v1"
INPUT_VERSION = "embed-v1"
PREVIEW = 240
OUTPUT = "struct<summary:string,keywords:array<string>,hypothetical_questions:array<string>,entities:array<string>,topics:array<string>,table_summary:string,code_summary:string,api_symbols:array<string>>"


def policy(kind: Column, content: Column, config: Enrichment = Enrichment()) -> Column:
    """eligible, content_kind_not_enabled or below_min_chars; tables have no least length."""
    return F.when(~kind.isin(*config.kinds), "content_kind_not_enabled").when((kind != "table") & (F.length(content) < config.min_chars), "below_min_chars").otherwise("eligible")


def validated(kind: Column, raw: Column) -> Column:
    """The cleaned output as a struct, or null if a required part is missing."""

    def cleaned(out: Column) -> Column:
        text = {k: F.nullif(normalize_whitespace_ends(out[k]), F.lit("")) for k in ("summary", "table_summary", "code_summary")}
        lists = {k: clean_strings(out[k]) for k in ("keywords", "hypothetical_questions", "entities", "topics", "api_symbols")}
        return F.struct(*(v.alias(k) for k, v in (text | lists).items()))

    def fits(made: Column) -> Column:
        whole = made["summary"].isNotNull() & made["keywords"].isNotNull() & made["hypothetical_questions"].isNotNull()
        whole &= (kind != "table") | made["table_summary"].isNotNull()
        return whole & ((kind != "code") | made["code_summary"].isNotNull() | made["api_symbols"].isNotNull())

    return kept_if(once(F.from_json(raw, OUTPUT), cleaned), fits)


def default_model(kind: str, content: str) -> str:
    words = list(dict.fromkeys(w.strip(".,:;").lower() for w in content.split() if len(w) > 4))[:5] or ["text"]
    summary = " ".join(content.split())[:120]
    return json.dumps({"summary": summary, "keywords": words, "hypothetical_questions": [f"What is {words[0]}?"], "table_summary": summary, "code_summary": summary})


def enrich(chunks: DataFrame, config: Enrichment = Enrichment(), model: Callable[[str, str], str] = default_model) -> DataFrame:
    """Adds status (success, failed, skipped_by_policy), reason and enrichment; partitions are the bounded worker pool."""

    @F.pandas_udf("string")
    def ask(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def one(kind: str, content: str, verdict: str) -> str | None:
            if verdict != "eligible":
                return None
            try:
                return with_retries(lambda: with_deadline(lambda: model(kind, content), config.timeout_s), config.retries)
            except Exception:
                return None

        for kinds, contents, verdicts in parts:
            yield pd.Series([one(*x) for x in zip(kinds, contents, verdicts, strict=True)], dtype=object)

    small_batches(chunks.sparkSession)
    rows = chunks.withColumn("reason", policy(F.col("content_kind"), F.col("content"), config))
    rows = rows.withColumn("reply", ask("content_kind", "content", "reason")).withColumn("enrichment", validated(F.col("content_kind"), F.col("reply")))
    status = F.when(F.col("reason") != "eligible", "skipped_by_policy").when(F.col("enrichment").isNotNull(), "success").otherwise("failed")
    why = F.when(F.col("reason") != "eligible", F.col("reason")).when(F.col("reply").isNull(), "model_failed").when(F.col("enrichment").isNull(), "invalid_enrichment_output")
    return rows.withColumn("status", status).withColumn("reason", why).drop("reply")


def embedding_input(title: Column, path: Column, kind: Column, content: Column, enrichment: Column) -> Column:
    """Labelled lines for an enriched chunk; the content alone without enrichment."""

    def joined(label: str, values: Column) -> Column:
        return F.when(F.size(values) > 0, F.concat(F.lit(label), F.array_join(values, ", ")))

    def of_kind(name: str, label: str, value: Column) -> Column:
        return F.when((kind == name) & value.isNotNull(), F.concat(F.lit(label), value))

    kind_name = F.when(kind == "table", "Table").when(kind == "code", "Code").otherwise("Prose")

    def lines(made: Column) -> Column:
        asked = made["hypothetical_questions"]
        questions = F.when(F.size(asked) > 0, F.concat(F.lit("Questions:\n"), F.array_join(F.transform(asked, lambda q: F.concat(F.lit("- "), q)), "\n")))
        return F.concat_ws(
            "\n", F.concat(F.lit("Document: "), title), F.concat(F.lit("Path: "), F.array_join(path, " > ")), F.concat(F.lit("Type: "), kind_name), F.concat(F.lit("Summary: "), made["summary"]),
            of_kind("table", "Table Summary: ", made["table_summary"]), of_kind("code", "Code Summary: ", made["code_summary"]), joined("Keywords: ", made["keywords"]), joined("Topics: ", made["topics"]),
            joined("Entities: ", made["entities"]), joined("Symbols: ", made["api_symbols"]), questions, F.lit("Content:"), content,
        )

    return once(enrichment, lambda made: F.when(made.isNull(), content).otherwise(lines(made)))


def preview(text: Column) -> Column:
    """What is kept of an embedding input beside its chunk."""
    return F.substring(text, 1, PREVIEW)


def content_hash(kind: Column, text: Column) -> Column:
    """Digest of one element's kind and text."""
    return F.md5(F.concat(kind, F.lit(":"), text))


def processing_hash(content_hash: Column, config: Enrichment = Enrichment()) -> Column:
    """Digest of what makes a page's chunks; the fields' order counts."""
    kinds = [k for k in ("prose", "table", "code") if config.enabled and k in config.kinds]
    fields = (content_hash.alias("parsedHash"), F.lit(VERSION).alias("enrichmentVersion"), F.lit(INPUT_VERSION).alias("embeddingInputVersion"), F.array(*map(F.lit, kinds)).alias("enabledContentKinds"), F.lit(config.min_chars).alias("minChars"))
    return F.sha2(F.to_json(F.struct(*fields)), 256)
