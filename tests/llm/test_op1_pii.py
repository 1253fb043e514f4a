import hashlib
import random
import re
from collections import Counter

from helpers import documents, prose, save
from pyspark.sql import functions as F

from millrace.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base(text):
    """The rules of the contract, read literally."""
    out = []
    for kind, rule in enumerate((EMAIL, IP, CARD, PHONE)):
        for m in rule.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2 and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def written_out(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)


NASTY = [
    None, "", "a@b", "a@b.c_d@e.f", "x@y@z.w", "@a.b", "é@a.bc ünï@x.yz", "a@b..c", "..@--.--", "1.2.3.4.5.6.7.8", "999.1.2.3 1.2.3.256 01.002.3.4 255.255.255.255", "1..2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111-", "41111111111111111",
    "+1 (555) 123-4567 x", "+49 30 1234567890123456789", "++12345678901", "+1 5+15551234567", "🙂 +44 20 7946 0958 🙂 a@b.co", "0" * 5000, "1 2 3 4 5 6 7 8 9 0 1 2 3 4", "1  2", "a@b.c,d@e.f;g@h.i", "user@host.com.", "1.2.3.4@host.org +1.2.3.4.5.6.7.8.9.0", "4111111111111111@x.y",
    "line\n+1 555 123 4567\n4111 1111 1111 1111\n", "5500005555555559 is 378282246310005",
]


def corpus():
    rng = random.Random(12)
    texts = list(NASTY)
    for _ in range(200):
        texts.append("".join(rng.choices("0123456789+-(). @ab.c\n", k=rng.randrange(5, 90))))
    for i in range(30):
        texts.append(f"{prose(rng, 8)}\nPlease write to person{i}@mail{i}.example.com for help\nMy server is at 10.0.{i}.{i + 1} now")
    texts += [f"Please write to hidden{i}(at)mail.example.org for more" for i in range(3)]
    return texts


def test_base_spans_equal_the_rules(spark, tmp_path):
    rows = [*enumerate(corpus()), (0, "twice a@b.co"), (None, "1.2.3.4")]
    folder = save(documents(spark, rows), tmp_path, "documents")
    got = pii.op1_pii(spark, folder).collect()
    assert len(got) == len(rows)
    expected = {}
    for doc_id, text in rows:
        spans = base(text or "")
        expected.setdefault(doc_id, []).append((*(sum(k == n for _, k, _ in spans) for n in range(4)), hashlib.sha256(written_out(spans).encode()).hexdigest()))
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append((r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}
    by_id = dict(rows[: len(rows) - 2])
    for r in got:
        if r.doc_id in by_id and r.doc_id != 0:
            mine = set(filter(None, r.spans.split(",")))
            assert set(filter(None, written_out(base(by_id[r.doc_id] or "")).split(","))) <= mine
            assert len(mine) == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added


def test_confident_patterns_find_unseen_identifiers(spark):
    texts = corpus()
    rows = {r.doc_id: r for r in pii.report(documents(spark, list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        if text and "(at)" in text:
            at = text.index("hidden")
            assert f"email:{at}:{at + len(text[at:].split()[0])}" in rows[i].spans.split(",")
    assert all(rows[i].n_added == 0 for i, t in enumerate(texts) if t and "river" in t and "@mail" in t)


def test_rare_contexts_count_beside_many_seeds(spark):
    rows = [(i, f"word{i} other{i} user{i}@mail{i}.example.com") for i in range(1300)]
    rows += [(2000 + i, f"kindly contact person{i}@mail.example.com") for i in range(5)] + [(3000, "kindly contact hidden(at)mail.example.com")]
    found = {r.doc_id: r for r in pii.report(documents(spark, rows)).collect()}
    assert found[3000].spans == "email:15:41" and sum(r.n_added for r in found.values()) == 1


def brute_added(texts):
    """Bootstrapping in plain Python: the added (start, kind, end) of each text."""
    candidate = re.compile(r"(?<!\S)(?=\S*(?:[0-9@]|[(\[]at[)\]]))\S++(?: [0-9()][0-9()-]++)*+")

    def context(text, s):
        line = text[:s].split("\n")[-1]
        return tuple(re.split(" +", "^ " + line.lower())[-3:-1]) if s and text[s - 1] == " " and line.strip(" ") else None

    seeds, cands, follows = {}, [], Counter()
    for text in texts:
        text = text or ""
        spans = base(text)
        for s, k, e in spans:
            if c := context(text, s):
                seeds.setdefault((k, c), Counter())[text[s:e]] += 1
        own = []
        for m in candidate.finditer(text):
            v = m.group().rstrip(".,;:!?)'\"*#$%&|")
            s, e = m.start(), m.start() + len(v)
            if len(v) >= pii.LEAST_SIGNS and not any(a < e and s < b for a, _, b in spans) and (c := context(text, s)):
                own.append((s, e, v, c))
        cands.append(own)
        for line in filter(None, text.lower().split("\n")):
            w = re.split(" +", "^ " + line)
            follows.update(zip(w, w[1:-1], strict=False))
    patterns = {p: sum(v.values()) for p, v in seeds.items() if len(v) >= pii.MIN_SEEDS}
    edges = Counter((k, c, v) for own in cands for _, _, v, c in own for k in range(4) if (k, c) in patterns)
    sure = {p: n / follows[p[1]] for p, n in patterns.items()}
    for _ in range(pii.ROUNDS):
        score = {}
        for k, c, v in edges:
            score[k, v] = score.get((k, v), 1.0) * max(1 - sure[k, c], 1e-9)
        more = Counter()
        for (k, c, v), m in edges.items():
            more[k, c] += m * (1 - score[k, v])
        sure = {p: min(1.0, (n + more[p]) / follows[p[1]]) for p, n in patterns.items()}
    return [sorted({(s, k, e) for s, e, _, c in own for k in range(4) if sure.get((k, c), 0) >= pii.CONFIDENT}) for own in cands]


def test_added_spans_equal_brute_force(spark):
    rng = random.Random(51)
    texts = [None, ""]
    places = ["write to", "host is", "call me", "x" * 100 + " at", "x" * 90 + " " + "y" * 95]
    for i in range(90):
        k = rng.randrange(5)
        seed = (f"p{i}@m{i}.example.com", f"10.1.{i}.7", f"+1 555 010 {1000 + i}")[k % 3 if rng.random() < 0.95 else rng.randrange(3)]
        hidden = rng.choice((f"q{i % 7}(at)m.example.com", f"555-01{i}-2233", "nothing here", f"id{i}x99"))
        texts.append(f"{prose(rng, 5)} {places[k]} {seed if rng.random() < 0.75 else hidden} {prose(rng, 3)}\nsee also {hidden} 12 34")
    found = {r.doc_id: r for r in pii.report(documents(spark, list(enumerate(texts)))).collect()}
    added = brute_added(texts)
    assert sum(map(len, added)) > 5
    for i, text in enumerate(texts):
        assert found[i].n_added == len(added[i])
        assert found[i].spans == written_out(sorted([*base(text or ""), *added[i]]))


def test_long_words_before_an_identifier_keep_their_context(spark):
    far = "https://" + "a" * 90 + " address"
    rows = [(i, f"{far} user{i}@mail.example.com") for i in range(4)] + [(9, f"{far} other(at)mail.example.com")]
    found = {r.doc_id: r for r in pii.report(documents(spark, rows)).collect()}
    assert found[9].spans == f"email:{len(far) + 1}:{len(far) + 26}"


def test_mask_keeps_columns_whose_names_clash(spark):
    names = ["email", "ip", "card", "phone", "t", "spans", "apart", "masked", "added", "key", "my col"]
    docs = documents(spark, [(1, "mail a.b@c.de")])
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(k))
    row = pii.mask(docs).first()
    assert row.text == "mail [EMAIL]" and [row[n] for n in names] == list(range(len(names)))


def test_mask_keeps_columns_and_other_text(spark):
    docs = documents(spark, [(1, "mail a.b@c.de or 10.0.0.1 ok"), (2, None), (3, ""), (4, "nothing"), (1, "mail a.b@c.de or 10.0.0.1 ok")]).withColumnRenamed("source", "key")
    out = pii.mask(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in out.collect() if r.text) == [(1, "mail [EMAIL] or [IP] ok")] * 2 + [(4, "nothing")]
    assert {(r.doc_id, r.text) for r in out.collect() if not r.text} == {(2, None), (3, "")}


def test_empty_table(spark):
    assert pii.report(documents(spark, [])).count() == 0 and pii.mask(documents(spark, [])).count() == 0


def test_main_path_has_no_python(spark):
    plan = pii.report(documents(spark, [(1, "a@b.co")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
