import math
import random

import numpy as np
from helpers import documents, save
from pyspark.sql import functions as F

from millrace.llm import langid

COMMON = {
    "en": "the of and that with for this have from they will would there their what about which when make like time just know people into year good some could them other than then only come over think also back after work first well even want because any these give most".split(),
    "de": "der die und das nicht ist ein auch mit sich auf für werden dem sind wurde aber nach durch über wenn noch einer haben schon wieder gegen könnte zwischen während müssen größer können Straße heißt schön weiß deutlich Menschen zurück".split(),
    "fr": "les des est pour dans une que qui pas sur avec plus tout être comme mais nous vous leur bien même aussi après très année fait peut où déjà français était entre encore toujours quelque élève été près château beaucoup".split(),
    "es": "los que del una por con para como más pero sus este también fue había muy años entre está cuando todo sobre según desde hasta donde quien mañana niño español país después así porque días mundo".split(),
}


def corpus(n=240, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choices(list(COMMON), (5, 2, 2, 1))[0]
        rows.append((i, " ".join(rng.choices(COMMON[lang], k=rng.randrange(12, 80))), lang, f"www.{lang}{i % 3}.example.{'com' if lang == 'en' else lang}"))
    return rows


def test_held_out_accuracy(spark):
    train, held = corpus(), corpus(200, 77)
    model = langid.Grams.train([r[1] for r in train], [r[2] for r in train])
    hidden = documents(spark, held).withColumn("lang", F.lit(None).cast("string"))
    found = {r.doc_id: r for r in langid.identify(langid.from_documents(hidden), model).collect()}
    right = sum(found[r[0]].language == r[2] for r in held)
    assert right >= 0.99 * len(held)
    assert all(found[r[0]].kept for r in held)


def test_query_keeps_every_row_and_identifies_it(spark, tmp_path):
    rows = corpus() + [(1000, None, "en", "s"), (1001, "", None, None), (1002, "?? 123 !!", "en", None), (None, corpus()[0][1], corpus()[0][2], None), (5, "der die und", None, None), (5, "der die und", None, None)]
    folder = save(documents(spark, rows), tmp_path, "documents")
    got = langid.op4_language_id(spark, folder).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[r[0]].language == r[2] and by_id[r[0]].kept for r in rows[:240] if r[0] != 5)
    assert all(by_id[i].language is None and not by_id[i].kept for i in (1000, 1001, 1002))
    assert [r.language for r in got if r.doc_id == 5].count("de") >= 2


def test_metadata_and_host_decide_where_the_text_does_not(spark):
    train = corpus()
    model = langid.Grams.train([r[1] for r in train], [r[2] for r in train])
    rows = [*train, (2000, "xx yy", "es", "www.es0.example.es"), (2001, "xx yy", "de", "www.de1.example.de"), (2002, "xx yy", None, "www.fr2.example.fr")]
    found = {r.doc_id: r.language for r in langid.identify(langid.from_documents(documents(spark, rows)), model).collect()}
    assert (found[2000], found[2001], found[2002]) == ("es", "de", "fr")


def brute(rows, model):
    """Posteriors of rows (id, text, declared, suffix, host) in plain Python."""
    names, n = model.languages, len(model.languages)
    like, share = [], []
    for _, text, *_ in rows:
        score, grams, _ = model.score(text or "")
        e = [math.exp(x - max(score)) for x in score]
        like.append((score, grams))
        share.append([x / sum(e) for x in e] if grams and any(score) else [0.0] * n)
    mass = [sum(p[i] for p in share) for i in range(n)]
    overall = [(m + 1) / (sum(mass) + n) for m in mass]

    def sums(pick):
        out = {}
        for row, p in zip(rows, share, strict=True):
            if pick(row) is not None:
                out[pick(row)] = [a + b for a, b in zip(out.get(pick(row), [0.0] * n), p, strict=True)]
        return out

    smooth = lambda own, above, w: [(x + w * a) / (sum(own) + w) for x, a in zip(own, above, strict=True)]
    domain_of = lambda host: ".".join(host.split(".")[-2:]) if host and "." in host else None
    domains = {k: smooth(v, overall, langid.DOMAIN_WEIGHT) for k, v in sums(lambda r: domain_of(r[4])).items()}
    hosts = {k: smooth(v, domains.get(domain_of(k), overall), langid.HOST_WEIGHT) for k, v in sums(lambda r: r[4]).items()}
    signs = {c: {k: [(v[i] + (langid.AGREE if k == names[i] else langid.DISAGREE)) / (mass[i] + langid.AGREE + n * langid.DISAGREE) for i in range(n)] for k, v in sums(lambda r, c=c: r[c]).items()} for c in (2, 3)}
    out = {}
    for row, (score, grams) in zip(rows, like, strict=True):
        logs = [score[i] + math.log(hosts.get(row[4], overall)[i]) + sum(math.log(signs[c][row[c]][i]) for c in (2, 3) if row[c] is not None) for i in range(n)]
        best = max(range(n), key=lambda i: (logs[i], -i))
        out[row[0]] = (names[best], 1 / sum(math.exp(x - logs[best]) for x in logs)) if grams else (None, None)
    return out


def test_posterior_equals_brute_force_and_each_kind_of_evidence_decides(spark):
    train = corpus()
    model = langid.Grams.train([r[1] for r in train], [r[2] for r in train])
    rows = [(i, text, lang, lang if lang != "en" else None, host) for i, text, lang, host in train]
    unclear = "xx yy"
    rows += [(2000, unclear, None, None, None), (2001, unclear, "de", None, None), (2002, unclear, None, "fr", None), (2003, unclear, None, None, "www.de1.example.de"), (2004, unclear, None, None, "new.es0.example.es"), (2005, train[0][1], "de", "de", "www.de1.example.de"), (2006, None, "de", "de", None)]
    found = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, declared string, suffix string, host string"), model).collect()}
    for i, (language, posterior) in brute(rows, model).items():
        assert found[i].language == language
        assert posterior is None or abs(found[i].posterior - posterior) < 2e-6
    alone = found[2000].language
    assert [found[i].language for i in (2001, 2002, 2003)] == ["de", "fr", "de"] and alone == "es"
    assert found[2005].language == train[0][2]  # a clear text stands against the rest


def test_rare_languages_are_known(spark):
    rows = [(i, " ".join(COMMON["en"]), "en", "s") for i in range(300)] + [(1000, " ".join(COMMON["fr"]), "fr", "s")]
    assert set(langid.training_sample(documents(spark, rows), limit=20)[1]) == {"en", "fr"}


def test_very_long_texts_and_ties(spark):
    train = corpus()
    model = langid.Grams.train([r[1] for r in train], [r[2] for r in train])
    rows = [(1, " ".join(COMMON["de"]) * 10_000, None, None), (2, "zz", None, None)]
    found = {r.doc_id: r.language for r in langid.identify(langid.from_documents(documents(spark, rows)), model).collect()}
    assert found[1] == "de" and found[2] in COMMON
    tied = langid.Grams(["aa", "bb"], np.zeros((langid.BUCKETS, 2)), -np.inf)
    assert langid.identify(langid.from_documents(documents(spark, [(1, "some letters", None, None)])), tied).first().language == "aa"


def test_page_query(spark, tmp_path):
    save(documents(spark, corpus()), tmp_path, "documents")
    body = " ".join(COMMON["fr"])
    pages = spark.createDataFrame([(1, "https://a.example.fr/x", f"<html lang=fr><p>{body}</p>"), (2, "https://b.example.com/es/", "<html lang='es'><p>xx</p>"), (3, None, None)], "page_id long, url string, html string")
    folder = save(pages, tmp_path, "pages")
    found = {r.page_id: r.language for r in langid.page_language(spark, folder).collect()}
    assert found == {1: "fr", 2: "es", 3: None}


def test_query_uses_all_four_kinds_of_evidence(spark, tmp_path):
    known = [(i, text, lang, f"src{i % 3}") for i, text, lang, _ in corpus()]
    hosts = [(i + 1000, text, lang, f"https://www{i % 3}.{lang}.net/{i}") for i, text, lang, _ in corpus(120, 6)]
    rows = [*known, *hosts, (2000, "xx yy", "de", None), (2001, "xx yy", "fr-CA", None), (2002, "xx yy", None, "https://new.example.com/de/1"), (2003, "xx yy", None, "new.example.fr"), (2004, "xx yy", None, "https://other.fr.net"), (2005, "der die und das nicht ist ein auch", "fr", None), (2006, "xx yy", None, None)]
    found = {r.doc_id: r for r in langid.op4_language_id(spark, save(documents(spark, rows), tmp_path, "documents")).collect()}
    assert [found[i].language for i in range(2000, 2005)] == ["de", "fr", "de", "fr", "fr"]
    assert found[2005].language == "de" and found[2006].language not in ("de", "fr")
    assert all(found[i].language == lang for i, _, lang, _ in known)


def test_label_of_a_training_row_is_no_evidence_again(spark):
    train = corpus()
    model = langid.Grams.train([r[1] for r in train], [r[2] for r in train], once=True)
    rows = [*train, (1000, train[0][1], "zz", None), (1001, "und", "de", None), (1002, None, "de", None)]
    found = {r.doc_id: r.declared for r in langid.identify(langid.from_documents(documents(spark, rows)), model).collect()}
    assert found == {**{r[0]: None for r in train}, 1000: "zz", 1001: "de", 1002: "de"}


def test_verdicts_of_one_text_differ_by_its_declared_language(spark):
    rows = [(i, text, lang, "s") for i, text, lang, _ in corpus() if lang != "en"]
    rows += [(1000 + i, "xx yy", lang, "s") for i, lang in enumerate(["de", None])]
    docs = documents(spark, rows)
    model = langid.Grams.train(*langid.training_sample(docs), once=True)
    wanted = {r.doc_id: r.kept for r in langid.identify(langid.from_documents(docs), model).collect()}
    assert wanted[1000] and not wanted[1001]
    assert sorted(r.doc_id for r in langid.keep_identified(docs).collect()) == sorted(i for i, kept in wanted.items() if kept)


def test_foreign_text_is_rejected(spark):
    train = corpus()
    model = langid.Grams.train([r[1] for r in train], [r[2] for r in train])
    rows = [*train, (3000, "こんにちは世界 これは日本語の文章です " * 10, "en", "s"), (3001, "zqxj wvkq xzzq jjqk " * 20, "en", "s")]
    found = {r.doc_id: r for r in langid.identify(langid.from_documents(documents(spark, rows)), model).collect()}
    assert not found[3000].kept and not found[3001].kept


def test_pages_give_markup_suffix_and_host(spark):
    pages = spark.createDataFrame([(1, "https://Shop.example.de/x", '<html lang="de-AT"><script>var a</script><p>und</p>'), (2, "https://a.example.com/fr/1", "<p>x</p>"), (3, None, None)], "page_id long, url string, html string")
    found = {r.doc_id: (r.declared, r.suffix, r.host) for r in langid.from_pages(pages).collect()}
    assert found == {1: ("de", "de", "shop.example.de"), 2: (None, "fr", "a.example.com"), 3: (None, None, None)}


def test_keep_identified_keeps_columns_and_clean_documents(spark):
    rows = [*corpus(), (1000, None, "en", "s"), (1001, "", None, None), (7, "der die und das nicht", "de", "x"), (7, "der die und das nicht", "de", "x")]
    docs = documents(spark, rows).withColumnRenamed("n_chars", "__n").withColumns({"host": F.lit(1), "__verdict": F.lit("v"), "my col": F.lit(2)})
    kept = langid.keep_identified(docs)
    assert kept.where("__verdict <> 'v' OR `my col` <> 2 OR host <> 1").count() == 0
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted([*range(240), 7, 7])


def test_empty_and_unlabelled_tables(spark, tmp_path):
    assert langid.op4_language_id(spark, save(documents(spark, []), tmp_path, "documents")).count() == 0
    unlabelled = documents(spark, [(1, "no labels here at all", None, None)])
    assert langid.keep_identified(unlabelled).count() == 0
