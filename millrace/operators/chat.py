"""Chat: history shaping, context, citations, sources, the ambiguity gate, and answers with model fallback."""

from __future__ import annotations

import json
import logging
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cited_indexes, cut_with_dots, is_fallback, normalize_whitespace_ends, strip_references
from .models import with_deadline

LAST_TURNS, TURN_CHARS = 12, 500
LOG = logging.getLogger(__name__)


def history(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role (user or model) and text: trimmed, not empty, from the first user turn on, without the last message.

    The bounds are partial aggregates, so a very long conversation is never gathered in one task.
    """
    rows = messages.select("conv_id", "turn", F.when(F.col("role") == "user", "user").otherwise("model").alias("role"), normalize_whitespace_ends(F.coalesce("text", F.lit(""))).alias("text"))
    spoken = F.when((F.col("role") == "user") & (F.col("text") != ""), F.col("turn"))
    bounds = rows.groupBy("conv_id").agg(F.max("turn").alias("last"), F.min(spoken).alias("first"))
    return rows.where("text <> ''").join(bounds, "conv_id").where("turn >= first AND turn < last").drop("first", "last")


def last_turns(messages: DataFrame, n: int = LAST_TURNS) -> DataFrame:
    """The last ``n`` messages of each conversation, each cut to the gate's length."""
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = messages.withColumn("back", F.row_number().over(back)).where(F.col("back") <= n)
    return rows.select("conv_id", "turn", "role", F.when(F.col("text") == "", "(empty)").otherwise(cut_with_dots(F.col("text"), TURN_CHARS)).alias("text"))


def rendered_history(messages: DataFrame) -> DataFrame:
    """conv_id and the gate's view of its history."""
    rows = last_turns(messages).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("h"))
    return rows.select("conv_id", F.array_join(F.transform("h", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("history"))


def promoted_titles(messages: DataFrame, default: str = "New Conversation") -> DataFrame:
    """conv_id, title: the first user message's first 160 signs, or the default."""
    first = F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))
    return messages.groupBy("conv_id").agg(F.coalesce(F.substring(first, 1, 160), F.lit(default)).alias("title"))


def message_verdict(role: Column, text: Column, limit: int = 8000) -> Column:
    """ok, or why a message is refused."""
    body = normalize_whitespace_ends(F.coalesce(text, F.lit("")))
    return F.when(~F.coalesce(role, F.lit("")).isin("user", "assistant"), "bad_role").when(body == "", "empty").when(F.length(body) > limit, "too_long").otherwise("ok")


def is_live(created: Column, now: Column, days: int = 7) -> Column:
    """Whether a session of that length has not ended yet."""
    return created + F.make_dt_interval(F.lit(days)) > now


def owned(rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """The rows whose key an owner has."""
    return rows.join(owners, key, "left_semi")


def context(chunks: Column) -> Column:
    """Numbered sources of an array of (url, content)."""
    return F.array_join(F.transform(chunks, lambda x, i: F.concat(F.lit("[Source "), (i + 1).cast("string"), F.lit("] ("), x["url"], F.lit("):\n"), x["content"])), "\n\n---\n\n")


def cited_sources(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """answer_id, number, title, url of the cited sources (answer_id, position, title, url); one for each url, none for a fallback answer.

    An answer may have several rows (paragraphs).
    """
    cited = answers.where(~is_fallback(F.col("text"))).select("answer_id", F.explode(cited_indexes(F.col("text"))).alias("position")).distinct()
    first = F.min(F.struct(F.col("position").alias("number"), "title")).alias("first")
    return cited.join(sources, ["answer_id", "position"]).groupBy("answer_id", "url").agg(first).select("answer_id", "first.number", "first.title", "url")


def clean_answer(text: Column) -> Column:
    return strip_references(text)


def ambiguity(message: str, turns: str, enabled: bool, model: Callable[[str], str], seconds: float = 2.0) -> tuple[str, str | None]:
    """("clarify", question) or ("proceed", None); whatever goes wrong means proceed."""
    if not enabled:
        return "proceed", None
    try:
        reply = with_deadline(lambda: model(f"Is this message clear enough to search for?\nHistory:\n{turns or '(none)'}\nMessage: {message}"), seconds)
        data = json.loads(re.search(r"\{.*\}", reply, re.S).group(0))
        question = (data.get("clarificationQuestion") or "").strip()
        if set(data) <= {"decision", "clarificationQuestion"} and data["decision"] == "clarify" and question:
            return "clarify", question
    except Exception:
        pass
    return "proceed", None


class ModelMissing(Exception):
    """A model name that the service does not know."""


def answer(prompt: str, models: list[str], send: Callable[[str, str], str], verbose: bool = False) -> tuple[str, str]:
    """(model, text) of the first model that exists; other errors are not caught. ``verbose`` logs what each model is sent."""
    for name in dict.fromkeys(models):
        if verbose:
            LOG.info("prompt %s", {"model": name, "prompt": prompt})
        try:
            return name, send(name, prompt)
        except ModelMissing as e:
            last = e
    raise last
