"""The pipeline against plain Python: rules read literally, all pairs, counting, and the tokenizers library."""

import hashlib
import random
import re
from array import array

from helpers import documents, save
from test_op1_pii import base
from test_op4_language_id import corpus
from test_op5_near_dup import brute as near_classes
from test_op8_decontamination import WORD, words
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import bpe, decontam, pii


def decontaminated(text, windows):
    w, places = words(text), [m.span() for m in WORD.finditer(text)]
    hit, found = set(), set()
    for i in range(len(w) - 7):
        if (k := tuple(w[i : i + 8])) in windows:
            hit.update(range(i, i + 8))
            found |= windows[k]
    if len(found) >= 2 or len(hit) > decontam.MAX_COVERAGE * max(1, len(w)):
        return None
    out, at = "", 0
    for i in sorted(hit):
        if i - 1 not in hit:
            out += text[at : places[i][0]]
        at = places[i][1]
    return out + text[at:]


def masked(text):
    spans = [list(x) for x in base(text)]
    apart = []
    for s, k, e in spans:
        if apart and s < apart[-1][2]:
            apart[-1][2] = max(apart[-1][2], e)
        else:
            apart.append([s, k, e])
    for s, k, e in reversed(apart):
        text = text[:s] + f"[{pii.KINDS[k].upper()}]" + text[e:]
    return text


def rows_and_items():
    rng = random.Random(17)
    items = [(i, " ".join(f"item{i}word{j}" for j in range(14))) for i in range(4)]
    rows = []
    for i, text, lang, source in corpus(120, 9):
        if i % 10 == 0:
            text += f" {items[i % 4][1]}"
        if i % 15 == 0:
            text += f" {items[(i + 1) % 4][1]}"
        if i % 7 == 0:
            text += f" {rng.choice('abc')}{i}@host{i}.org"
        if i % 11 == 0:
            text += f"\n10.1.{i}.3"
        rows.append((i, text, lang, source))
    more = []
    for i, text, lang, source in rows[:40]:
        if i % 3 == 0:
            more.append((500 + i, text, lang, source))
        if i % 4 == 0 and len(text.split()) > 50:
            w = text.split()
            w[10] = "changed"
            more.append((600 + i, " ".join(w), lang, source))
    blank = [(700, None, "en", "s"), (701, "", None, None), (702, "123 ?!", "en", "s")]
    return [*rows, *more, *blank, (None, rows[1][1] + " one more sentence of it", "en", "s")], items


def test_run_equals_plain_python(spark, tmp_path):
    rows, items = rows_and_items()
    save(documents(spark, rows), tmp_path, "documents")
    folder = save(spark.createDataFrame(items, "item_id long, text string"), tmp_path, "benchmark")
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect())

    clean = [r for r in rows if r[1] and re.search("[a-z]", r[1])]
    numbered = [(i if r[0] is None else r[0], r[1]) for i, r in enumerate(clean, 10_000)]
    keep = {c for _, c in near_classes(numbered)}
    windows = {}
    for name, text in items:
        w = words(text)
        for i in range(len(w) - 7):
            windows.setdefault(tuple(w[i : i + 8]), set()).add(name)
    library = Tokenizer.from_file(bpe.default_path())
    expected = []
    for (number, text), row in zip(numbered, clean, strict=True):
        if number in keep and (text := decontaminated(text, windows)) is not None:
            text = masked(text)
            ids = library.encode(text, add_special_tokens=False).ids
            expected.append((str(row[0]), len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(expected)


def test_stages_keep_columns(spark, tmp_path):
    rows, items = rows_and_items()
    docs = documents(spark, rows)
    folder = save(spark.createDataFrame(items, "item_id long, text string"), tmp_path, "benchmark")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "pii", "bpe"]
    before = len(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"file://{tmp_path}/{name}"
        stage(spark, docs, folder).write.parquet(path)
        out = spark.read.parquet(path)
        assert out.dtypes == docs.dtypes
        docs, n = out, out.count()
        assert n <= before
        before = n
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == before


def test_empty_tables(spark, tmp_path):
    save(documents(spark, []), tmp_path, "documents")
    folder = save(spark.createDataFrame([], "item_id long, text string"), tmp_path, "benchmark")
    assert corpus_pipeline.run(spark, folder).count() == 0
