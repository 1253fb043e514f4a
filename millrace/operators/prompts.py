"""Prompts of the model-backed steps as Column templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import cut_with_dots

_PARTS = {"table": "table_summary (what the rows and columns say)", "code": "code_summary (what the code does) or api_symbols (names that it uses)"}


def rewrite(query: Column) -> Column:
    return F.concat_ws("\n", F.lit("Rewrite this search query so that documentation is found by it. Keep names and quoted words; reply with the query only."), F.concat(F.lit("Query: "), query))


def enrichment(kind: Column, title: Column, path: Column, content: Column) -> Column:
    """Asks for the parts that a chunk of this kind needs."""
    extra = F.when(kind == "table", _PARTS["table"]).when(kind == "code", _PARTS["code"])
    wanted = F.concat_ws(", ", F.lit("Reply with JSON: summary, keywords, hypothetical_questions, entities, topics"), extra)
    return F.concat_ws("\n", wanted, F.concat(F.lit("Document: "), title), F.concat(F.lit("Path: "), F.array_join(path, " > ")), F.lit("Content:"), content)


def ambiguity(message: Column, history: Column) -> Column:
    shown = F.when(F.coalesce(history, F.lit("")) == "", "(none)").otherwise(history)
    return F.concat_ws("\n", F.lit("Is this message clear enough to search for? Reply with JSON: decision (proceed or clarify), clarificationQuestion."), F.lit("History:"), shown, F.concat(F.lit("Message: "), message))


def candidate(chunk_id: Column, content: Column, limit: int = 1200) -> Column:
    """One passage of a reranking prompt."""
    return F.concat(F.lit("["), chunk_id.cast("string"), F.lit("] "), cut_with_dots(content, limit))


def system(context: Column, subject: str = "documentation") -> Column:
    """The answer's instructions with its numbered sources."""
    rules = f"Answer from the sources below only, and cite them as [1] or [1, 2]. If they do not say, reply: I don't know based on the indexed {subject}."
    return F.concat_ws("\n\n", F.lit(rules), context)
