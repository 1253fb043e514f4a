import random
import re
from collections import Counter

import numpy as np
from helpers import documents, prose, save

from millrace.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    wins = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {k for i in range(len(words) - 7) if wins[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed


def good(rng):
    return "\n".join(prose(rng, rng.randrange(8, 30)).capitalize() + "." for _ in range(rng.randrange(3, 9)))


def bad(rng):
    if rng.random() < 0.5:
        return "\n".join(" | ".join(prose(rng, 10).split()) for _ in range(5))
    return " ".join(w + rng.choice(("###", "$$$", "%%%")) for w in prose(rng, 60).split())


def tables(spark):
    rng = random.Random(21)
    labels = {i: int(rng.random() < 0.7) for i in range(200)}
    rows = [(i, good(rng) if y else bad(rng)) for i, y in labels.items()]
    loop = " ".join(f"w{i}" for i in range(9))
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, f"{loop} x {loop} " * 3), (1004, "a\nb\na\n \n\n a\na"), (1005, "é ü x " * 30), (1006, "\x1cone\x1dtwo " * 15), (1007, "x" * 100_000 + " y"), (0, rows[0][1]), (None, rows[1][1])]
    return rows, labels


def test_query_base_and_verdict(spark, tmp_path):
    rows, labels = tables(spark)
    save(documents(spark, rows).withColumnRenamed("source", "quality"), tmp_path, "documents")
    folder = save(spark.createDataFrame([*((i, y, 0) for i, y in labels.items()), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    got = quality.op10_quality(spark, folder).collect()
    base = lambda r: tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    assert sorted(map(base, got), key=str) == sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert not any(r.kept for r in got if r.base_failed)
    judged = [r for r in got if r.doc_id in labels and not r.base_failed]
    assert sum(r.kept == bool(labels[r.doc_id]) for r in judged) >= 0.97 * len(judged)
    assert all(r.kept for r in judged if labels[r.doc_id])


def test_held_out_accuracy():
    rng = random.Random(31)
    texts, ys = zip(*((good(rng), 1) if rng.random() < 0.6 else (bad(rng), 0) for _ in range(250)), strict=True)
    field = quality.LineField.train(list(texts[:150]), list(ys[:150]))
    right = sum((field.share(quality.lines_of(t)[0]) >= field.threshold) == bool(y) for t, y in zip(texts[150:], ys[150:], strict=True))
    assert right >= 97


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    field = quality.LineField(rng.normal(size=(len(quality.FEATURES), 2)), rng.normal(size=(2, 2)))
    for n in range(1, 9):
        f = (rng.random((n, len(quality.FEATURES))) < 0.4).astype(float).tolist()

        def score(labels, f=f):
            s = sum(field.gain[k] * x for row, y in zip(f, labels, strict=True) if y for k, x in enumerate(row))
            return s + sum(field.move[a, b] for a, b in zip(labels, labels[1:], strict=False))

        best = max(score([i >> k & 1 for k in range(n)]) for i in range(1 << n))
        assert abs(score(field.decode(f)) - best) < 1e-9


def mixed(rng):
    """Boilerplate lines with a content line before and behind them, and the true labels."""
    lines = [prose(rng, 9).capitalize() + ".", *(" | ".join(prose(rng, 10).split()) for _ in range(rng.randrange(3, 6))), prose(rng, 12).capitalize() + "."]
    return "\n".join(lines), [1, *[0] * (len(lines) - 2), 1]


def test_labels_change_within_a_document():
    rng = random.Random(41)
    texts, ys = zip(*((good(rng), 1) if k % 2 else (mixed(rng)[0], 0) for k in range(200)), strict=True)
    field = quality.LineField.train(list(texts), list(ys))
    for _ in range(20):
        text, truth = mixed(rng)
        assert field.label(quality.lines_of(text)[0]) == truth
    assert np.ptp(field.move) > 0.5  # lines like their neighbours


def test_verdict_follows_the_best_labelling(spark):
    rng = random.Random(43)
    texts = [mixed(rng)[0] for _ in range(10)] + [good(rng) for _ in range(10)]
    field = quality.LineField(threshold=0.4)
    got = {r.doc_id: r for r in quality.score_documents(documents(spark, list(enumerate(texts))), field).collect()}
    for i, text in enumerate(texts):
        lines = quality.lines_of(text)[0]
        rows = [quality.line_features(*x) for x in lines]

        def score(labels, rows=rows):
            return sum(field.gain[k] * x for row, y in zip(rows, labels, strict=True) if y for k, x in enumerate(row)) + sum(field.move[a, b] for a, b in zip(labels, labels[1:], strict=False))

        best = max(([i >> k & 1 for k in range(len(lines))] for i in range(1 << len(lines))), key=score)
        share = sum(n for (_, n, _), y in zip(lines, best, strict=True) if y) / sum(n for _, n, _ in lines)
        assert (got[i].n_lines, got[i].n_content_lines) == (len(lines), sum(best)) and abs(got[i].content_share - share) < 1e-9
        assert got[i].kept == (not brute(text)[5] and share >= 0.4)


def test_without_labels_and_empty(spark, tmp_path):
    rng = random.Random(2)
    save(documents(spark, [(1, good(rng)), (2, bad(rng))]), tmp_path, "documents")
    folder = save(spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    assert {r.doc_id: r.kept for r in quality.op10_quality(spark, folder).collect()} == {1: True, 2: False}
    assert quality.score_documents(documents(spark, []), quality.LineField()).count() == 0
