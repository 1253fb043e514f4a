import random
from collections import Counter

from helpers import documents, prose, save
from pyspark.sql import functions as F

from millrace.llm import near_dup


def plain_similar(a: list[str], b: list[str]) -> bool:
    """Jaccard of labelled five-word shingles and word edit distance, by the textbook."""
    if a == b:
        return True

    def shingles(w):
        n = min(5, len(w))
        return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()

    x, y = shingles(a), shingles(b)
    union = sum((x | y).values())
    if not union or sum((x & y).values()) < 0.8 * union:
        return False
    row = list(range(len(b) + 1))
    for i, p in enumerate(a, 1):
        new = [i]
        for j, q in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != q)))
        row = new
    return row[-1] <= 0.2 * max(len(a), len(b))


def brute(rows):
    words = [near_dup.words_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if find(i) != find(j) and plain_similar(words[i], words[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        r = find(i)
        least[r] = doc_id if r not in least else min(least[r], doc_id)
    return sorted((rows[i][0], least[find(i)]) for i in range(len(rows)))


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = f"new{rng.randrange(10**6)}"
        elif kind == 1:
            words.insert(at, f"more{rng.randrange(10**6)}")
        elif len(words) > 30:
            del words[at]
    return " ".join(words)


def corpus():
    rng = random.Random(11)
    rows = [None, "", "  \n ", "one two", "one two", "ONE TWO", "one two three four five six"]
    for _ in range(12):
        base = prose(rng, rng.randrange(40, 250))
        rows.append(base)
        for _ in range(rng.randrange(0, 6)):
            rows.append(edited(rng, base, rng.randrange(1, 4)))
        if rng.random() < 0.5:
            rows += [base, base.upper()]
        halves = base.split()
        rows.append(" ".join(halves[len(halves) // 2 :] + halves[: len(halves) // 2]))  # same words, other order
    return [(i + 3, t) for i, t in enumerate(rows)]


def test_classes_equal_all_pairs(spark, tmp_path):
    rows = corpus()
    folder = save(documents(spark, rows), tmp_path, "documents")
    found = near_dup.op5_near_dup(spark, folder).collect()
    assert sorted((r.doc_id, r.class_id) for r in found) == brute(rows)
    size = Counter(r.class_id for r in found)
    assert all(r.class_size == size[r.class_id] for r in found)


def test_group_of_many_near_copies(spark):
    rng = random.Random(4)
    base = prose(rng, 120)
    rows = [(i, edited(rng, base, 2)) for i in range(150)] + [(1000 + i, prose(rng, 60)) for i in range(20)]
    found = {r.doc_id: r.class_id for r in near_dup.classes(documents(spark, rows)).collect()}
    assert {found[i] for i in range(150)} == {0}
    assert all(found[i] == i for i in range(1000, 1020))


def test_links_inside_a_templated_group(spark):
    rng = random.Random(21)
    template = [f"t{i}" for i in range(154)]
    rows = []
    for i in range(250):
        head = [f"h{i}a", f"h{i}b"]
        rows += [(2 * i + j, " ".join(template + head + [f"own{rng.randrange(10**9)}" for _ in range(18)])) for j in (0, 1)]
    assert plain_similar(rows[0][1].split(), rows[1][1].split()) and not plain_similar(rows[0][1].split(), rows[2][1].split())
    bands = [set(near_dup.bands(near_dup.kmers(t.split(), near_dup.WordHash()))) for _, t in rows]
    found = {r.doc_id: r.class_id for r in near_dup.classes(documents(spark, rows)).collect()}
    assert all(found[2 * i + 1] == 2 * i for i in range(250) if bands[2 * i] & bands[2 * i + 1])
    assert all(found[2 * i] == 2 * i for i in range(250))


def test_dedup_keeps_one_of_each_class_and_all_columns(spark):
    rows = corpus()
    docs = documents(spark, [*rows, rows[8], (None, "alone in the world " * 4)]).withColumnRenamed("source", "digest")
    kept = near_dup.dedup(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert got == sorted([(False, c) for c in {c for _, c in brute(rows)}] + [(True, 0)])


def test_empty_table(spark):
    docs = documents(spark, [])
    assert near_dup.classes(docs).count() == 0 and near_dup.dedup(docs).count() == 0


def test_alignment_distance():
    rng = random.Random(8)
    for _ in range(200):
        a, b = (rng.choices("abc", k=rng.randrange(0, 12)) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, p in enumerate(a, 1):
            new = [i]
            for j, q in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != q)))
            row = new
        assert near_dup.alignment_distance(a, b, 12) == row[-1]
        assert near_dup.alignment_distance(a, b, 2) == (row[-1] if row[-1] <= 2 else None)


def test_very_long_texts_and_columns_whose_names_clash(spark):
    rng = random.Random(77)
    long = prose(rng, 60_000)
    rows = [(1, long), (2, long + " and a little more"), (3, prose(rng, 60)), (4, prose(rng, 60))]
    docs = documents(spark, rows).withColumns({c: F.lit(i) for i, c in enumerate(("digest", "band", "class_id", "__text", "my col", "keep"))})
    kept = {r.doc_id: r for r in near_dup.dedup(docs).collect()}
    assert sorted(kept) == [1, 3, 4] and kept[1].text == long
    assert all([r[c] for c in ("digest", "band", "class_id", "__text", "my col", "keep")] == list(range(6)) for r in kept.values())
