"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior over the known languages:

* the text: byte n-gram likelihoods, trained on a bounded sample of labelled rows (``TRAIN_DOCS`` over all languages,
  each language its share, so that rare ones are known too), per gram and tempered, since neighbouring grams are not
  independent; beyond ``MAX_GRAMS`` grams more text adds no certainty, so that other evidence keeps its say;
* the language that the markup declares and the address suffix: how often each value goes with each language,
  counted over all rows with a share for agreement as the prior;
* the host: its mix of languages by grouped sums over all its rows, smoothed towards its domain's mix, and that one
  towards the corpus's.

``from_pages`` and ``from_documents`` give all four. A document's declared language is its lang, and its address is its
source where that has a host with dots. The rows of the training sample, and copies of them with the same lang, have had
their say in the text model, so theirs is no evidence again: ``Grams.train`` is given ``once`` to leave it out.

The first pass reads the texts and writes a short row for each document; counts and fusion are DataFrame aggregations
and joins over those rows. A document is rejected if its text has no letters, looks like none of the known languages
(mean likelihood under a bound calibrated on the training rows; texts of fewer than ``FLOOR_GRAMS`` grams are too short
to tell and pass), or no language has ``MIN_POSTERIOR``.

Defined results: null and empty texts are rejected with language null; null metadata is no evidence; repeated and
null ids are kept row by row; texts of any length are read whole; ties go to the first language in order of name; an
empty table gives no rows; other columns than doc_id, text, lang and source are not read and come through
``keep_identified`` unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, small_batches, table, written

TRAIN_DOCS = 2000
TRAIN_SIGNS = 4000
BUCKETS = 1 << 15
TEMPER = 0.3
MAX_GRAMS = 300
FLOOR_GRAMS = 30
MIN_POSTERIOR = 0.5
AGREE, DISAGREE = 20.0, 1.0
HOST_WEIGHT = DOMAIN_WEIGHT = 5.0


class Grams:
    """Byte trigrams (by a hash) with smoothed log probabilities for each language."""

    def __init__(self, languages: list[str], table_: np.ndarray, floor: float, used: frozenset[bytes] = frozenset()):
        self.languages, self.table, self.floor, self.used = languages, table_, floor, used

    @staticmethod
    def ids(text: str) -> np.ndarray:
        raw = np.frombuffer(f" {' '.join(text.lower().split())} ".encode(), np.uint8).astype(np.uint32)
        if len(raw) < 3:
            return np.zeros(0, np.uint32)
        packed = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
        letter = (raw >= 97) & (raw <= 122) | (raw >= 128)
        space = letter | (raw == 32)
        packed = packed[letter[1:-1] & space[:-2] & space[2:]]
        return (packed * np.uint32(2654435761)) >> np.uint32(17)

    @staticmethod
    def label(text: str, language: str) -> bytes:
        return hashlib.md5(f"{language}:{text[:TRAIN_SIGNS]}".encode()).digest()

    @classmethod
    def train(cls, texts: list[str], languages: list[str], once: bool = False) -> Grams:
        """``once``: the declared language of a training row is not used as evidence about it."""
        names = sorted(set(languages))
        counts = np.full((BUCKETS, max(1, len(names))), 0.05)
        all_ids = [cls.ids(t) for t in texts]
        for ids, name in zip(all_ids, languages, strict=True):
            counts[:, names.index(name)] += np.bincount(ids, minlength=BUCKETS)
        model = cls(names, np.log(counts / counts.sum(0)), -np.inf)
        means = [m.max() for ids in all_ids if len(ids) >= FLOOR_GRAMS for m in [model.table[ids].mean(0)]]
        if means:
            model.floor = float(np.quantile(means, 0.001) - 2.5)
        if once:
            model.used = frozenset(map(cls.label, texts, languages))
        return model

    def declared(self, text: str, language: str | None) -> str | None:
        """The declared language, where the model has not learned it from this text."""
        return None if language and self.used and self.label(text, language) in self.used else language

    def score(self, text: str) -> tuple[list[float], int, float]:
        """Tempered log likelihoods, number of grams (1 for letters too few for a gram), and the best mean log likelihood."""
        ids = self.ids(text)
        if not len(ids):
            return [0.0] * len(self.languages), int(any(map(str.isalpha, text))), 0.0
        mean = self.table[ids].mean(0)
        return (mean * (min(len(ids), MAX_GRAMS) * TEMPER)).tolist(), len(ids), float(mean.max())


def primary_tag(tag: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(tag, "^[A-Za-z]{2,3}", 0)), F.lit(""))


def training_sample(docs: DataFrame, limit: int = TRAIN_DOCS) -> tuple[list[str], list[str]]:
    """About ``limit`` labelled rows, by a hash of id and text; of each the first ``TRAIN_SIGNS`` signs, for training only.

    Labels are counted over all rows, and each language gets an equal share of the sample (all its rows where it has fewer).
    """
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL AND length(text) >= 40").select("doc_id", F.substring("text", 1, TRAIN_SIGNS).alias("text"), primary_tag(F.col("lang")).alias("lang")).where("lang IS NOT NULL")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return [], []
    each = max(1, limit // len(counts))
    bound = F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, int(min(1.0, each / n) * (1 << 30)))))
    found = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < bound[F.col("lang")]).limit(2 * max(limit, len(counts))).collect()
    found.sort(key=str)
    return [r.text for r in found], [r.lang for r in found]


def _host(url: str) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _suffix(url: str, host: Column) -> Column:
    """First path part of two letters, else the host's country suffix."""
    part = F.regexp_extract(url, r"://[^/?#]*/([a-zA-Z]{2})(?:[/?#]|$)", 1)
    top = F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    return F.nullif(F.when(part != "", F.lower(part)).otherwise(top), F.lit(""))


def from_documents(docs: DataFrame) -> DataFrame:
    """Documents in the operator's input form: lang as declared, source as the address or as a host by its bare name."""
    host = F.coalesce(_host("source"), F.lower("source"))
    return docs.select("doc_id", "text", primary_tag(F.col("lang")).alias("declared"), _suffix("source", host).alias("suffix"), host.alias("host"))


def from_pages(pages: DataFrame) -> DataFrame:
    """Pages in the operator's input form: language of the html element, country suffix or first path part, host."""
    host = _host("url")
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>|&[a-zA-Z#0-9]+;", " ")
    return pages.select(F.col("page_id").alias("doc_id"), text.alias("text"), primary_tag(F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)).alias("declared"), _suffix("url", host).alias("suffix"), host.alias("host"))


def text_evidence(rows: DataFrame, model: Grams) -> DataFrame:
    """The short rows: doc_id, declared, suffix, host, domain, grams, best mean, likelihoods and text posterior."""
    small_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def load():
        own = shared.value

        def step(source: Iterable[tuple]) -> Iterator[tuple]:
            for doc_id, text, declared, suffix, host in source:
                like, n, best = own.score(text or "")
                top = max(like, default=0.0)
                p = np.exp(np.array(like) - top)
                domain = ".".join(host.split(".")[-2:]) if host and "." in host else None
                yield doc_id, own.declared(text or "", declared), suffix, host, domain, n, best, like, (p / p.sum()).tolist() if n and any(like) else [0.0] * len(like)

        return step

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, declared string, suffix string, host string, domain string, grams int, best double, likely array<double>, p array<double>"
    return map_rows(rows.select("doc_id", "text", "declared", "suffix", "host"), schema, load)


def _sums(n: int) -> list[Column]:
    return [F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(n)]


def fuse(evidence: DataFrame, languages: list[str], floor: float) -> DataFrame:
    """doc_id, language, posterior, text_language, declared and kept of every short row."""
    n = len(languages)
    every = range(n)
    totals = evidence.agg(*_sums(n)).first()
    mass = [float(x or 0.0) for x in totals]
    overall = [(m + 1.0) / (sum(mass) + n) for m in mass]

    def smoothed(over: DataFrame, key: str, weight: float, above: list[Column | float], out: str) -> DataFrame:
        size = sum((F.col(f"s{i}") for i in every), F.lit(0.0))
        return over.withColumn(out, F.array(*((F.col(f"s{i}") + weight * above[i]) / (size + weight) for i in every)))

    hosts = written(evidence.where("host IS NOT NULL").groupBy("host", "domain").agg(*_sums(n)), "hosts")
    domains = hosts.where("domain IS NOT NULL").groupBy("domain").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in every))
    domains = smoothed(domains, "domain", DOMAIN_WEIGHT, [F.lit(x) for x in overall], "above").select("domain", "above")
    joined = hosts.join(domains, "domain", "left").withColumn("above", F.coalesce("above", F.array(*map(F.lit, overall))))
    prior = written(smoothed(joined, "host", HOST_WEIGHT, [F.col("above")[i] for i in every], "prior").select("host", "prior"), "host-priors")
    out = evidence.join(prior, "host", "left")
    for sign in ("declared", "suffix"):
        seen = evidence.where(F.col(sign).isNotNull()).groupBy(sign).agg(*_sums(n))
        # P(sign | language), with agreement as the prior
        share = [(F.col(f"s{i}") + F.when(F.col(sign) == languages[i], AGREE).otherwise(DISAGREE)) / (mass[i] + AGREE + n * DISAGREE) for i in every]
        out = out.join(written(seen.select(sign, F.array(*share).alias(f"{sign}_like")), f"{sign}-evidence"), sign, "left")
    logs = [
        F.col("likely")[i]
        + F.log(F.coalesce(F.col("prior")[i], F.lit(overall[i])))
        + F.coalesce(F.log(F.col("declared_like")[i]), F.lit(0.0))
        + F.coalesce(F.log(F.col("suffix_like")[i]), F.lit(0.0))
        for i in every
    ]
    out = out.withColumn("logs", F.array(*logs)).withColumn("top", F.array_max("logs"))
    out = out.withColumn("post", F.expr("transform(logs, x -> exp(x - top))"))
    names = F.array(*map(F.lit, languages))
    best = F.expr("1 / aggregate(post, 0D, (a, x) -> a + x)")
    known = F.col("grams") > 0
    kept = known & (best >= MIN_POSTERIOR) & ((F.col("best") >= floor) | (F.col("grams") < FLOOR_GRAMS))
    return out.select(
        "doc_id",
        F.when(known, F.element_at(names, F.array_position("logs", F.col("top")).cast("int"))).alias("language"),
        F.when(known, F.round(best, 6)).alias("posterior"),
        F.when(known, F.element_at(names, F.array_position("likely", F.array_max("likely")).cast("int"))).alias("text_language"),
        "declared",
        kept.alias("kept"),
    )


def identify(rows: DataFrame, model: Grams) -> DataFrame:
    """Language and verdict of every row of the input form of ``from_documents`` or ``from_pages``."""
    if not model.languages:
        return rows.select("doc_id", F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("posterior"), F.lit(None).cast("string").alias("text_language"), "declared", F.lit(False).alias("kept"))
    return fuse(written(text_evidence(rows, model), "language-evidence"), model.languages, model.floor)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is identified, in the columns of ``docs``.

    Verdicts are joined by a 128-bit digest of text, source and lang, on which alone they depend.
    """
    model = Grams.train(*training_sample(docs), once=True)
    signs = [F.coalesce(F.concat(F.length(c), F.lit(":"), F.col(c)), F.lit("-")) for c in ("source", "lang")]
    verdict = F.unhex(F.md5(F.concat(*signs, F.coalesce(F.concat(F.lit("+"), "text"), F.lit("-")))))
    shaped = docs.select("text", "source", "lang", verdict.alias("doc_id"))
    rejected = identify(from_documents(shaped), model).where("NOT kept").select(F.col("doc_id").alias("__verdict")).distinct()
    rejected = written(rejected, "rejected-languages", compact=True)
    own = docs.select(F.struct("*").alias("__row"), verdict.alias("__verdict"))
    return own.join(rejected, "__verdict", "left_anti").select(*(F.col("__row").getField(c).alias(c) for c in docs.columns))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return identify(from_documents(docs), Grams.train(*training_sample(docs), once=True))


def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and verdict of every page, from its text, markup, address suffix and host; the text model is that of the documents."""
    return identify(from_pages(table(spark, sf_dir, "pages")), Grams.train(*training_sample(table(spark, sf_dir, "documents")))).withColumnRenamed("doc_id", "page_id")
