import random
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from millrace.functions.stem import stem
from millrace.operators import lexical


@pytest.mark.parametrize(
    ("word", "expected"),
    [
        ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("gas", "gas"), ("gaps", "gap"), ("kiwis", "kiwi"), ("consistency", "consist"), ("consigned", "consign"), ("hopping", "hop"), ("hoping", "hope"), ("luxuriated", "luxuri"),
        ("generously", "generous"), ("communism", "communism"), ("knightly", "knight"), ("knives", "knive"), ("sky", "sky"), ("dying", "die"), ("happy", "happi"), ("enjoy", "enjoy"), ("agreed", "agre"), ("relational", "relat"), ("conditional", "condit"),
        ("rational", "ration"), ("valenci", "valenc"), ("electricity", "electr"), ("hopefulness", "hope"), ("adjustment", "adjust"), ("controlling", "control"), ("succeeding", "succeed"), ("by", "by"), ("say", "say"), ("cry", "cri"),
    ],
)
def test_published_stems(word, expected):
    assert stem(word) == expected


def test_query_syntax():
    assert lexical.parse_query('running "server side" -old or plugins') == [[(False, ["run"]), (False, ["server", "side"]), (True, ["old"])], [(False, ["plugin"])]]
    assert lexical.parse_query("the of and") == []


def test_cover_density():
    own = lexical.positions("plugins run on the server side; a plugin running there")
    score = lambda q: lexical.fts_score(own, lexical.parse_query(q))
    assert score("plugin") == (True, 0.1 + 0.1)
    assert score("server side") == (True, 0.1)
    assert score("plugins running") == (True, pytest.approx(0.1 + 0.1 / 6 + 0.1))
    assert score("server missing") == (False, 0.0) and score("server -side") == (False, 0.0)
    assert score("missing or side") == (True, 0.1) and score('"side server"') == (False, 0.0) and score('"server side"')[0]
    assert score("-missing") == (True, 0.0)


def chunks(spark):
    rows = [(1, "the server proxy handles requests"), (2, "proxies and servers"), (3, "unrelated words"), (4, None), (5, "")]
    return spark.createDataFrame(rows, "chunk_id int, content string")


def test_search_mixes_scores(spark):
    rows = {r.chunk_id: r for r in lexical.search(chunks(spark), lexical.trigram_postings(chunks(spark)), "server proxy", 5).collect()}
    assert set(rows) == {1, 2}
    assert rows[1].similarity == pytest.approx(0.7 * 0.1 + 0.3 * rows[1].trigram, abs=1e-6)


def test_limit_comes_before_the_second_filter(spark):
    rows = spark.createDataFrame([(1, "alpha"), (2, "zzz qqq")], "chunk_id int, content string")
    found = lexical.search(rows, lexical.trigram_postings(rows), "-missing", 1).collect()
    assert found == []  # a match of rank nought takes the only place and then goes


def test_threshold_is_strict(spark):
    rows = spark.createDataFrame([(1, "cat dog")], "chunk_id int, content string")
    postings = lexical.trigram_postings(rows)
    assert lexical.search(rows, postings, "cat", 5, 0.5, fts=False).count() == 0
    assert lexical.search(rows, postings, "cat", 5, 0.49, fts=False).count() == 1


def test_index_match(spark):
    rows = spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, None)], "chunk_id int, content string")
    assert lexical.fts_match(lexical.fts_postings(rows), ["a", "b"]).collect() == [(1, 3)]


@pytest.mark.parametrize(("query", "text"), [("fly", "we fly home"), ("try", "they try it"), ("dying", "he is dying"), ("sky", "the skies"), ("tied", "tying it"), ("was ran x", "nothing ran x")])
def test_stemmed_matches_are_found(spark, query, text):
    rows = spark.createDataFrame([(1, text), (2, "unrelated"), (3, None)], "chunk_id int, content string")
    assert [r.chunk_id for r in lexical.fts_scores(rows, query).collect()] == [1]
    assert [r.chunk_id for r in lexical.fts_scores_indexed(lexical.stem_postings(rows), query).collect()] == [1]


@given(st.text("abcdefghijklmnopqrstuvwxyz", min_size=1, max_size=9), st.sampled_from(["", "s", "es", "ies", "ing", "ed", "ly", "ness", "ation", "ization", "fulness", "ically", "ying", "ous", "er", "y", "able", "ement", "ational", "enci", "logi"]))
def test_a_word_holds_what_the_filter_asks_for(head, tail):
    assert lexical.surely_in(stem(head + tail)) in head + tail


def brute_rank(text, query):
    """Matches and covers counted interval by interval."""
    own, matched, rank = lexical.positions(text), False, 0.0
    for group in lexical.parse_query(query):
        at = [(neg, [p for p in own.get(x[0], ()) if all(p + k in own.get(y, ()) for k, y in enumerate(x))]) for neg, x in group]
        if any(bool(p) == neg for neg, p in at):
            continue
        matched = True
        wanted = {x for neg, lexemes in group if not neg for x in lexemes}
        places = sorted(p for x in wanted for p in own[x])
        covers = [(a, b) for a in places for b in places if a <= b and all(any(a <= p <= b for p in own[x]) for x in wanted)]
        least = [(a, b) for a, b in covers if not any((c, d) != (a, b) and a <= c and d <= b for c, d in covers)]
        rank += sum(0.1 / (1 + b - a + 1 - len(wanted)) for a, b in least)
    return matched, round(rank, 6)


def test_rank_and_search_equal_brute_force(spark):
    rng = random.Random(3)
    words = "fly flies flying try tried tries server servers serving the of proxy proxies plug plugin".split()
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 25))) for _ in range(120)]
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, content string").cache()
    stems = lexical.stem_postings(rows).cache()
    for query in ("fly", "try server", "flying or tried -proxy", '"server proxy" plugin', "serve fly try"):
        expected = {i: r for i, t in enumerate(texts) for m, r in [brute_rank(t, query)] if m}
        assert {r.chunk_id: r.fts for r in lexical.fts_scores(rows, query).collect()} == pytest.approx(expected)
        assert {r.chunk_id: r.fts for r in lexical.fts_scores_indexed(stems, query).collect()} == pytest.approx(expected)
        own = gram_set(query)
        mixed = []
        for i, t in enumerate(texts):
            tri = round(len(gram_set(t) & own) / len(gram_set(t) | own), 6)
            mixed.append((round(0.7 * expected.get(i, 0.0) + 0.3 * tri, 6), i, expected.get(i, 0.0), tri, i in expected))
        top = sorted((x for x in mixed if x[4] or x[3] > 0.18), key=lambda x: (-x[0], x[1]))[:10]
        best = [(i, s) for s, i, f, t, _ in top if f > 0 or t > 0.18]
        for postings in (None, lexical.trigram_postings(rows)):
            got = [(r.chunk_id, r.similarity) for r in lexical.search(rows, postings, query, 10, stems=stems).collect()]
            assert [s for _, s in sorted(got, key=lambda x: (-x[1], x[0]))] == pytest.approx([s for _, s in best], abs=2e-6)


def gram_set(text):
    return {f"  {w} "[k : k + 3] for w in re.findall(r"[^\W_]+", text.lower()) for k in range(len(w) + 1)}


def test_an_index_cannot_answer_negation_alone(spark):
    with pytest.raises(ValueError, match="negated"):
        lexical.fts_scores_indexed(lexical.stem_postings(chunks(spark)), "-missing")
