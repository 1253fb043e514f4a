"""Personal data by bootstrapped contextual extraction, in DataFrame and SQL expressions only.

Seeds are the base identifiers (e-mail, IP, card and phone numbers by rule). Each seed that stands after a blank
induces a lexical pattern: its kind and the two words before it in its line (``^`` for the line's start). The graph
of patterns and the values that they extract is scored in turns: a pattern's confidence is the summed score of what
follows it over all its occurrences in the corpus, a value's score is that of the patterns that extract it
(noisy or). Patterns with ``MIN_SEEDS`` different seeds or more and a confidence of ``CONFIDENT`` or more then tag
identifier-like words that the rules don't know (an obfuscated address, a number without its country code).

Texts are read twice: once for spans, candidates and their contexts, which are written to the shared folder (small
beside the texts), once to count the induced contexts. Copies of a text have the same spans, so discovered spans are
keyed by the text's digest and no row order or unique id is needed.

Defined results: null and empty texts have no spans; repeated and null ids are kept row by row; spans of different
kinds may overlap; positions are code points, ends exclusive; ties in order of start go by kind as listed; texts of any
length are read whole; an empty table gives no rows; other columns than doc_id and text are not read, and ``mask`` hands
them on unchanged, whatever their names. Words of fewer than ``LEAST_SIGNS`` signs are no candidates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

KINDS = ("email", "ip", "card", "phone")
MIN_SEEDS = 3
CONFIDENT = 0.6
ROUNDS = 3
NEAR = 80
#: Shorter words are no candidates: they are plain small numbers and list marks.
LEAST_SIGNS = 5
#: Context tables of up to this many rows (8-byte hashes) are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000

_RULES = {
    "email": r"(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\\+[0-9][ ().0-9-]+[0-9]",
}
_GUARDS = {"email": "instr(t, '@') > 0", "ip": "t rlike '[0-9][.][0-9]'", "card": "t rlike '[0-9][ -]?[0-9]'", "phone": "instr(t, '+') > 0"}
_DIGITS = "regexp_replace(x.v, '[^0-9]', '')"
_LUHN = (
    f"aggregate(sequence(1, length({_DIGITS})), 0, (a, i) -> a + if(i % 2 = 1, int(substring({_DIGITS}, -i, 1)),"
    f" if(int(substring({_DIGITS}, -i, 1)) > 4, 2 * int(substring({_DIGITS}, -i, 1)) - 9, 2 * int(substring({_DIGITS}, -i, 1))))) % 10 = 0"
)
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_CHECKS = {
    "email": "true",
    "ip": rf"x.v rlike '^{_PART}([.]{_PART}){{3}}$'",
    "card": f"length({_DIGITS}) between 14 and 19 and {_LUHN}",
    "phone": f"length({_DIGITS}) between 10 and 15",
}
#: Words with a digit, an @ or an (at), with the digit groups that go on after single blanks.
_CANDIDATE = r"(?<![^\\s])(?=[^\\s]*(?:[0-9@]|[(\\[]at[)\\]]))[^\\s]++(?: [0-9()][0-9()-]++)*+"
_SPAN = "array<struct<s:int,e:int,v:string>>"


def _places(rule: str) -> str:
    """SQL for the matches of a rule in t as structs (s, e, v): gaps and matches alternate, lengths add up to positions."""
    pairs = f"arrays_zip(split(t, '{rule}', -1), regexp_extract_all(t, '{rule}', 0))"
    start = "a.p + length(x.`0`)"
    step = f"named_struct('p', {start} + coalesce(length(x.`1`), 0), 'o', if(x.`1` is null, a.o, concat(a.o, array(named_struct('s', {start}, 'e', {start} + length(x.`1`), 'v', x.`1`)))))"
    return f"aggregate({pairs}, named_struct('p', 0, 'o', cast(array() as {_SPAN})), (a, x) -> {step}, a -> a.o)"


def _base(kind: str) -> str:
    return f"if({_GUARDS[kind]}, filter({_places(_RULES[kind])}, x -> {_CHECKS[kind]}), cast(array() as {_SPAN}))"


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (with the text in column t, not null) and a column for each kind with its base spans."""
    return docs.withColumns({kind: F.expr(_base(kind)) for kind in KINDS})


def _context(start: str) -> str:
    """SQL for the hash of the two words before a span that stands after a blank or at a line's start; null else.

    The line's last ``NEAR`` signs mostly hold two whole words; where they don't, the whole line is read.
    """
    near = f"substring_index(substring(t, greatest({start} - {NEAR}, 0) + 1, least({start}, {NEAR})), '\\n', -1)"
    whole = f"substring_index(substring(t, 1, {start}), '\\n', -1)"
    words = "split(concat('^ ', lower({})), ' +')"
    line = f"if({start} <= {NEAR} or length({near}) < {NEAR} or size({words.format(near)}) >= 5, {near}, {whole})"
    fits = f"{start} > 0 and substring(t, {start}, 1) = ' ' and length(trim({line})) > 0"
    return f"if({fits}, xxhash64(slice({words.format(line)}, -3, 2)), null)"


def analyse(docs: DataFrame) -> DataFrame:
    """doc_id, key (digest of the text), a column of spans for each kind, and candidates with their contexts; written."""
    rows = base_spans(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")))
    all_base = F.expr(f"concat({', '.join(f'transform({k}, x -> struct(x.s as s, x.e as e, {n} as k))' for n, k in enumerate(KINDS))})")
    trimmed = "transform({}, x -> named_struct('s', x.s, 'e', x.s + length(rtrim('.,;:!?)\\'\"*#$%&|', x.v)), 'v', rtrim('.,;:!?)\\'\"*#$%&|', x.v)))".format(_places(_CANDIDATE))
    fresh = f"filter({trimmed}, x -> length(x.v) >= {LEAST_SIGNS} and not exists(base, b -> b.s < x.e and x.s < b.e))"
    rows = rows.withColumn("base", all_base).withColumn("cand", F.expr(f"if(t rlike '[0-9@]|[(\\\\[]at[)\\\\]]', {fresh}, cast(array() as {_SPAN}))"))
    rows = rows.withColumns(
        {
            "key": F.md5(F.col("t")),
            "seeds": F.expr(f"filter(transform(base, x -> named_struct('k', x.k, 'v', xxhash64(substring(t, x.s + 1, x.e - x.s)), 'c', {_context('x.s')})), x -> x.c is not null)"),
            "cand": F.expr(f"filter(transform(cand, x -> named_struct('s', x.s, 'e', x.e, 'v', xxhash64(x.v), 'c', {_context('x.s')})), x -> x.c is not null)"),
        }
    )
    return written(rows.select("doc_id", "key", *(F.expr(f"transform({k}, x -> struct(x.s as s, x.e as e))").alias(k) for k in KINDS), "seeds", "cand"), "pii-spans")


def _context_counts(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """c, n: how often each induced context (written) stands before any word, over all texts. Counted before the join, so that a common context is one row of it."""
    line = F.explode(F.split(F.lower("text"), "\n")).alias("line")
    words = docs.where("text IS NOT NULL").select(line).where("line <> ''").select(F.split(F.concat(F.lit("^ "), F.col("line")), " +").alias("w"))
    seen = words.where("size(w) > 2").select(F.explode(F.expr("zip_with(slice(w, 1, size(w) - 2), slice(w, 2, size(w) - 2), (a, b) -> xxhash64(array(a, b)))")).alias("c"))
    counted = seen.groupBy("c").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(contexts) if contexts.count() <= BROADCAST_ROWS else contexts, "c")


def discover(docs: DataFrame, analysed: DataFrame, rounds: int = ROUNDS) -> DataFrame | None:
    """key, k (kind's number), s, e of the spans that confident patterns add; None if no pattern has enough seeds."""
    seeds = analysed.select(F.explode("seeds").alias("x")).select("x.*").groupBy("k", "c", "v").agg(F.count("*").alias("m"))
    seeds = written(seeds, "pii-seeds")
    patterns = seeds.groupBy("k", "c").agg(F.count("*").alias("n_seeds"), F.sum("m").alias("sure"))
    patterns = written(patterns.where(F.col("n_seeds") >= MIN_SEEDS), "pii-patterns")
    contexts = written(patterns.select("c").distinct(), "pii-contexts")
    if contexts.isEmpty():
        return None
    patterns = written(patterns.join(_context_counts(docs, contexts), "c"), "pii-counted")
    values = analysed.select(F.explode("cand").alias("x")).groupBy("x.c", "x.v").agg(F.count("*").alias("m"))
    edges = written(values.join(patterns, "c").select("k", "c", "v", "m"), "pii-edges")
    confidence = patterns.select("k", "c", (F.col("sure") / F.col("n")).alias("p"))
    for _ in range(rounds):
        score = edges.join(confidence, ["k", "c"]).groupBy("k", "v").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-9)))))).alias("score"))
        gained = edges.join(score, ["k", "v"]).groupBy("k", "c").agg(F.sum(F.col("m") * F.col("score")).alias("more"))
        confidence = patterns.join(gained, ["k", "c"], "left").select("k", "c", F.least(F.lit(1.0), (F.col("sure") + F.coalesce("more", F.lit(0.0))) / F.col("n")).alias("p"))
        confidence = written(confidence, "pii-confidence")
    trusted = confidence.where(F.col("p") >= CONFIDENT).select("k", "c")
    spans = analysed.select("key", F.explode("cand").alias("x")).select("key", "x.s", "x.e", "x.c").distinct()
    return written(spans.join(trusted, "c").select("key", "k", "s", "e").distinct(), "pii-found")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, key, a column of base spans for each kind, and added: array of (s, e, k) that the patterns gave."""
    analysed = analyse(docs)
    found = discover(docs, analysed)
    kept = analysed.select("doc_id", "key", *KINDS)
    empty = F.expr("cast(array() as array<struct<s:int,e:int,k:int>>)")
    if found is None:
        return kept.withColumn("added", empty)
    return kept.join(_by_text(found), "key", "left").withColumn("added", F.coalesce("added", empty))


def _by_text(found: DataFrame) -> DataFrame:
    """One row for each text that has added spans; bounded by the text's length."""
    return found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("s", "e", "k"))).alias("added"))


def _joined(spans: str) -> str:
    names = "array({})".format(", ".join(f"'{k}'" for k in KINDS))
    return f"array_join(transform(array_sort({spans}), x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')"


_ALL_BASE = "concat({})".format(", ".join(f"transform({k}, x -> named_struct('s', x.s, 'k', {n}, 'e', x.e))" for n, k in enumerate(KINDS)))
_ADDED = "transform(added, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e))"


def mask(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in brackets (spans that overlap: by the first one's), in the columns of ``docs``."""
    found = discover(docs, analyse(docs))
    rows = base_spans(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")))
    empty = F.expr("cast(array() as array<struct<s:int,e:int,k:int>>)")
    if found is None:
        rows = rows.withColumn("added", empty)
    else:
        rows = rows.withColumn("key", F.md5("t")).join(_by_text(found), "key", "left").withColumn("added", F.coalesce("added", empty))
    ordered = rows.withColumn("spans", F.expr(f"array_sort(concat({_ALL_BASE}, {_ADDED}))"))
    apart = (
        "aggregate(spans, cast(array() as array<struct<s:int,k:int,e:int>>), (a, x) -> if(size(a) > 0 and x.s < element_at(a, -1).e,"
        " concat(slice(a, 1, size(a) - 1), array(named_struct('s', element_at(a, -1).s, 'k', element_at(a, -1).k, 'e', greatest(element_at(a, -1).e, x.e)))), concat(a, array(x))))"
    )
    names = "array({})".format(", ".join(f"'[{k.upper()}]'" for k in KINDS))
    pieces = f"transform(apart, (x, i) -> concat(substring(t, if(i = 0, 0, apart[i - 1].e) + 1, x.s - if(i = 0, 0, apart[i - 1].e)), {names}[x.k]))"
    masked = f"if(size(apart) = 0, __row.text, concat(array_join({pieces}, ''), substring(t, element_at(apart, -1).e + 1)))"
    done = ordered.withColumn("apart", F.expr(apart)).withColumn("masked", F.expr(masked))
    return done.select(*(F.col("masked").alias("text") if c == "text" else F.col("__row").getField(c).alias(c) for c in docs.columns))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document; the contract's columns and the number of added spans."""
    return report(table(spark, sf_dir, "documents"))


def report(docs: DataFrame) -> DataFrame:
    rows = find(docs)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    base, spans = F.expr(_joined(_ALL_BASE)), F.expr(_joined(f"concat({_ALL_BASE}, {_ADDED})"))
    return rows.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"), F.size("added").cast("long").alias("n_added"))
