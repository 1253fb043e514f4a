import hashlib
import random
from array import array

import pytest
from helpers import documents, prose, save
from tokenizers import Tokenizer

from millrace.llm import bpe

NASTY = [
    None, "", " ", "\n\n  \t x", "a" * 3000, " " * 700 + "x", "the" * 900, "0123456789" * 80, "!?" * 400, "don't we'll I'VE 'sx 's", "naïve Größe Ωmega 東京タワー 🙂👩‍👩‍👧‍👦 é", "x<|endoftext|>y <|endof", "   a​b",
    "\r\n\r\nA\x00B\x7f�", "éàü" * 300, "١٢٣ ५६ ²³ ½", "__a__b--c", "don’t", "日本語" * 200, "'" * 100, " 's  's", "ͅᾳ ǅ", "Zz" * 40 + " " + "é" * 60,
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.default_path())


def texts():
    rng = random.Random(2)
    signs = "aeiou tsr \n.,'é0123ß東🙂-_" + "  "
    return NASTY + [prose(rng, 60)] + ["".join(rng.choices(signs, k=rng.randrange(1, 120))) for _ in range(150)]


def test_query_equals_the_library(spark, tmp_path, library):
    rows = list(enumerate(texts())) + [(0, "again"), (None, "no id")]
    folder = save(documents(spark, rows), tmp_path, "documents")
    got = bpe.op2_bpe(spark, folder).collect()

    def expected(doc_id, text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        return doc_id, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()

    assert sorted((tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in got), key=str) == sorted((expected(*r) for r in rows), key=str)


def test_streaming_in_pieces_equals_whole_texts(library, vocabulary):
    rng = random.Random(9)
    coder = bpe.Transducer(vocabulary)
    for text in texts():
        ids, at = [], 0
        while at < len(text or ""):
            n = rng.choice((1, 2, 3, 7, 40, 500))
            ids += coder.feed(text[at : at + n])
            at += n
        ids += coder.close()
        assert ids == library.encode(text or "", add_special_tokens=False).ids, text


def test_memory_of_a_long_pretoken_is_bounded(vocabulary):
    merger = bpe.Merger(vocabulary)
    for _ in range(300):
        merger.feed(b"abcdefghij" * 5)
        assert len(merger.window) <= 4 * vocabulary.lookahead


def test_lookahead_is_the_longest_token(vocabulary):
    assert vocabulary.lookahead == max(len(vocabulary.bytes_of[i]) for i in vocabulary.parts)


def test_decoder_holds_back_unfinished_signs(vocabulary):
    back = bpe.Detokenizer(vocabulary)
    ids = [vocabulary.byte[b] for b in "é東🙂".encode()]
    out = [back.feed([i]) for i in ids]
    assert [x for x in out if x] == ["é", "東", "🙂"] and back.close() == ""
    assert back.feed(ids[:1]) + back.close() == "�"


def test_empty_table(spark):
    assert bpe.digests(documents(spark, [])).count() == 0
    row = bpe.encode_documents(documents(spark, [(1, "some words")])).first()
    assert row.decoded == "some words" and len(row.ids) > 1


def test_clashing_columns_repeated_rows_and_very_long_texts(spark, library):
    text = "many words " * 50_000
    rows = documents(spark, [(1, text), (1, text), (2, None)]).withColumnRenamed("source", "ids").withColumnRenamed("lang", "n_tokens")
    got = sorted((r.doc_id, r.n_tokens) for r in bpe.digests(rows).collect())
    n = len(library.encode(text, add_special_tokens=False).ids)
    assert got == [(1, n), (1, n), (2, 0)]
