import pytest
from pyspark.sql import functions as F

from millrace.config import Enrichment, Retrieval, api_key, batch_size, threshold
from millrace.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("query", "reason"),
    [
        ("how do I set up a proxy server", "eligible"),
        ('"whole phrase" please', "quoted_query"),
        ("hmr", "query_too_short"),
        ("server.port", "identifier_like"),
        ("useConfig options", "identifier_like"),
        ("npm run build", "identifier_like"),
        ("what about that other option", "context_dependent"),
        ("How does it work then", "context_dependent"),
        ("word " * 31, "query_too_long"),
        ("  spaced   out  words ", "eligible"),
        ("tell me about pre-bundling", "identifier_like"),
        ("`x", "query_too_short"),
    ],
)
def test_rewrite_gate(spark, query, reason):
    assert one(spark, T.rewrite_gate(F.lit(query))) == reason
    assert one(spark, T.rewrite_gate(F.lit(query), False)) == "disabled"


def test_ends_are_trimmed_as_the_pattern_says(spark):
    signs = T.BLANK_SIGNS + "a\u200b\u0085\u2800"
    for text in ["", " ", "a", T.BLANK_SIGNS, *(f"{x}\u3000b {x}c\t{x}" for x in signs)]:
        pattern = F.regexp_replace(F.lit(text), rf"\A{T.BLANK}+|{T.BLANK}+\z", "")
        assert one(spark, T.normalize_whitespace_ends(F.lit(text))) == one(spark, pattern), repr(text)
    assert one(spark, T.normalize_whitespace_ends(F.lit(None).cast("string"))) is None


def test_token_estimate_of_signs_beyond_the_basic_plane(spark):
    assert one(spark, T.estimate_tokens(F.lit("\U0001f600" * 4))) == 1 and one(spark, T.estimate_tokens(F.lit("\U0001f600" * 4), utf16=True)) == 2
    assert one(spark, T.estimate_tokens(F.lit("\u20acbcde"), utf16=True)) == 2 and one(spark, T.estimate_tokens(F.lit(""), utf16=True)) == 0


def test_citations(spark):
    assert one(spark, T.cited_indexes(F.lit("x [2, 1] and [2][9], [0] [a] [3 4]"))) == [1, 2, 3, 9]
    assert one(spark, T.strip_references(F.lit("Answer [1].\n\n**References:**\n[1] a\nb"))) == "Answer [1]."
    assert one(spark, T.strip_references(F.lit("Answer.\nReferences: [1] a"))) == "Answer."
    assert one(spark, T.is_fallback(F.lit("I don't know based on the indexed pages")))


def test_text_forms(spark):
    assert one(spark, T.normalize_whitespace(F.lit(" a \n b\t"))) == "a b"
    assert one(spark, T.normalize_multiline(F.lit(" a \n\n  b\n"))) == "a\nb"
    assert one(spark, T.cut_with_dots(F.lit("abc  def"), 5)) == "abc..." and one(spark, T.cut_with_dots(F.lit("abc"), 5)) == "abc"
    assert [one(spark, T.mask_email(F.lit(x))) for x in ("abc@d.e", "ab@d.e", "x")] == ["ab***@d.e", "**@d.e", "redacted"]
    assert one(spark, T.code_language(F.lit("hl language-TS x"))) == "ts" and one(spark, T.code_language(F.lit("x"))) is None
    assert one(spark, T.json_body(F.lit('a ```json\n{"b": 1}\n``` c'))) == '{"b": 1}' and one(spark, T.json_body(F.lit("none"))) is None
    assert one(spark, T.clean_strings(F.array(F.lit(" a "), F.lit(""), F.lit("b"), F.lit("a"), F.lit(None)))) == ["a", "b"]
    assert one(spark, T.retry_seconds(F.lit("12.5s"))) == 12 and one(spark, T.retry_seconds(F.lit("12"))) is None
    assert one(spark, T.anchor_url(F.lit("u"), F.lit("a"))) == "u#a" and one(spark, T.anchor_url(F.lit("u"), F.lit(""))) == "u"
    assert one(spark, T.url_path_segments(F.lit("https://e.org/a//b/?q=1"))) == ["a", "b"] and one(spark, T.url_path_segments(F.lit("not one"))) is None
    assert one(spark, T.hard_cut(F.lit("abcde"), 2)) == ["ab", "cd", "e"] and one(spark, T.hard_cut(F.lit(""), 2)) == []


def test_boundaries(spark):
    assert one(spark, T.split_sentences(F.lit("a\n\nbb\n\nccc"), 4)) == ["a", "bb", "ccc"]
    assert one(spark, T.split_sentences(F.lit("One. Two! Three?"), 8)) == ["One.", "Two!", "Three?"]
    assert one(spark, T.split_sentences(F.lit("abcdefgh"), 3)) == ["abc", "def", "gh"]
    assert one(spark, T.split_sentences(F.lit("short"), 30)) == ["short"] and one(spark, T.split_sentences(F.lit(" "), 30)) == []


def test_trigrams(spark):
    assert sorted(one(spark, T.trigrams(F.lit("Cat cat")))) == ["  c", " ca", "at ", "cat"]
    assert one(spark, T.trigram_similarity(T.trigrams(F.lit("cat")), T.trigrams(F.lit("cats")))) == pytest.approx(3 / 6)
    assert one(spark, T.trigram_similarity(T.trigrams(F.lit("")), T.trigrams(F.lit("!")))) == 0.0


def test_settings():
    found = Retrieval.of({"HYBRID_RETRIEVAL_ENABLED": "true", "RERANKING_ENABLED": "yes", "HYBRID_PRE_FUSION_LIMIT": "20"})
    assert found.hybrid and not found.rerank and found.threshold == 0.55 and found.branch_limit() == 20
    assert Retrieval(limit=3).branch_limit() == 8 and Retrieval(hybrid=True, limit=6).branch_limit() == 18
    for env in ({"HYBRID_LEXICAL_TRIGRAM_THRESHOLD": "1"}, {"RERANKING_CANDIDATE_COUNT": "0"}, {"RERANKING_TIMEOUT_MS": "x"}):
        with pytest.raises(ValueError):
            Retrieval.of(env)
    with pytest.raises(ValueError):
        Enrichment.of({"ENRICH_CONTENT_KINDS": "prose,poem"})
    assert [threshold(x, 0.5) for x in ("0", "1", "1.1", None, "x")] == [0.0, 1.0, 0.5, 0.5, 0.5]
    assert [batch_size(x) for x in ("7", "0", "x", None)] == [7, 50, 50, 50]
    assert api_key({"SHARED": "s"}, "OWN", "SHARED") == "s"
    with pytest.raises(KeyError):
        api_key({}, "OWN", "SHARED")
