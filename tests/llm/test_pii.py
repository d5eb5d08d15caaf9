import random
import re

from pyspark.sql import functions as F

from recordfold.llm import pii

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(d):
    s = [int(c) for c in reversed(d)]
    return sum(s[0::2] + [2 * x - 9 * (x > 4) for x in s[1::2]]) % 10 == 0


def brute_base(text):
    t = text or ""
    num = lambda m: re.sub("[^0-9]", "", m)
    ok = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")),
          "card": lambda m: 16 <= len(num(m)) <= 19 and luhn(num(m)), "phone": lambda m: 8 <= len(num(m)) <= 15}
    return [(k, m.start(), m.end()) for k, p in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))
            for m in re.finditer(p, t) if ok[k](m.group())]


def corpus():
    rng = random.Random(4)
    fixed = [None, "", "no data", "a@b.c_d@e.f x", "a@b@c.d", "..@-.-", "x@y.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.4", "9" * 400 + ".1.1.1",
             "4111 1111 1111 1111 and 4111-1111-1111-1112, 5500005555555559", "+1 (415) 555-0100; +1.2", "+12345678901234567",
             "é🙂 mail: q.w+e@mail-1.example.com, call +33 1 23 45 67 89.", "IBAN DE89 3704 0044 0532 0130 00 x", "GB82WEST12345698765432", "DE89 3704 0044 0532 0130 00 AND", "DE89 3704 0044 0532 0130 00 A",
             "pay de89370400440532013000 now", "GB82 WEST 1234 5698 7654 32 EUR 20", "XX89370400440532013000 DE8937040044053201300", 
             "GB82WEST12345698765433", "amex card 378282246310005", "378282246310005", "a" * 50_000, "1 " * 3000, "+1((((((" * 500, "a.b" * 20_000 + "@x.y"]
    alphabet = ["@", ".", "-", " ", "+", "(", ")", "_", "a", "Z", "1", "22", "255", "4111111111111111", "é", "🙂", "\n", "x@y.z", "10.0.0.1"]
    return fixed + ["".join(rng.choice(alphabet) for _ in range(rng.choice([5, 20, 60]))) for _ in range(300)]


def test_report_has_exactly_the_base_spans(spark, make_docs):
    texts = corpus()
    docs = make_docs(texts).withColumn("spans", F.lit(1)).withColumn("row", F.lit(2)).withColumn("masked", F.lit(3))
    for g in pii.report(docs).collect():
        want = brute_base(texts[g.doc_id])
        assert g.base_spans == ",".join(f"{k}:{s}:{e}" for k, s, e in want), texts[g.doc_id][:80]
        assert (g.n_email, g.n_ip, g.n_card, g.n_phone) == tuple(sum(k == x for x, *_ in want) for k in pii.BASE)
        assert g.spans.startswith(g.base_spans)
    added = {g.doc_id: g.spans for g in pii.report(docs).collect()}
    at = texts.index("IBAN DE89 3704 0044 0532 0130 00 x")
    assert "iban:5:32" in added[at]
    assert "iban:0:22" in added[texts.index("GB82WEST12345698765432")] and "iban" not in added[texts.index("GB82WEST12345698765433")]
    want = {"DE89 3704 0044 0532 0130 00 AND": "iban:0:27", "DE89 3704 0044 0532 0130 00 A": "iban:0:27", "pay de89370400440532013000 now": "iban:4:26",
            "GB82 WEST 1234 5698 7654 32 EUR 20": "iban:0:27"}
    assert all(span in added[texts.index(t)].split(",") for t, span in want.items())
    assert "iban" not in added[texts.index("XX89370400440532013000 DE8937040044053201300")]
    for r in pii.report(docs).collect():
        assert len(r.scores.split(",")) == len(r.spans.split(",")) and all(0.5 <= float(x) <= 1 for x in r.scores.split(",") if x)
    assert pii.report(docs.limit(0)).count() == 0
    assert "short_card:10:25" in added[texts.index("amex card 378282246310005")] and "short" not in added[texts.index("378282246310005")]


def test_redaction_masks_unions(spark, make_docs):
    docs = make_docs([(1, "hi a@b.co, ip 10.0.0.1!"), (2, None), (3, "clean"), (3, "clean"), (4, "+1.10.20.30.40")])
    got = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert got[1].text == "hi [EMAIL], ip [IP]!" and got[1].n_chars == len(got[1].text)
    assert got[2].text is None and got[3].text == "clean" and pii.redact(docs).columns == docs.columns
    assert "1.10" not in got[4].text and pii.redact(docs).count() == 5
    assert pii.redact(docs.limit(0)).count() == 0
