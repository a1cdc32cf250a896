"""Secrets and personal data against plain loops over Python's regular expressions."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from newsgauge.llm import pii, registry, secret_scan, spans

SF = "/root/testdata/sf0.001"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id long, text string, base string, rid string")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def text_of(found):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("password|passwd|secret|token|api_?key", "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ["password", "passwd", "secret", "token", "api_?key"])))


def brute_secrets(text):
    text = text or ""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))


def brute_linked(text, scope=300):
    text = text or ""
    base = brute_secrets(text)
    weak = [("token", m.start(), m.end()) for m in re.finditer(secret_scan.TOKEN, text, re.A) if re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[0-9]", m[0])]
    weak += [("login", m.start(), m.end()) for m in re.finditer(secret_scan.LOGIN, text, re.A)]
    weak += [("endpoint", m.start(), m.end()) for m in re.finditer(secret_scan.ENDPOINT, text, re.A)]
    weak = [w for w in weak if not any(b[1] <= w[1] < b[2] for b in base)]
    every = base + weak
    linked = [
        w for w in weak
        if any(secret_scan.ROLE[p[0]] in secret_scan.COMPLETES[w[0]] and abs(p[1] - w[1]) <= scope for p in every)
    ]
    order = secret_scan.BASE + secret_scan.WEAK
    return sorted(base + linked, key=lambda x: (x[1], order.index(x[0])))


def secret_rows():
    rng = random.Random(3)
    key, tok, hx = "AKIA" + "Q7" * 8, "aB3" * 9, "0123456789abcdef" * 2
    rows = [
        (1, None), (2, ""), (3, f'Token = "{hx}" é {key}'), (4, "token=token:abcdef"), (5, "password: abcde secret='xyz.123' API_KEY=ab+/=-_9"),
        (6, "AKIAAKIA" + "Z" * 13), (7, "AKIASHORT"), (8, "é" * 50 + f"passwd={tok}"), (9, f"{tok} alone"), (10, f"user: bob {'x ' * 20}{tok}"),
        (11, f"user: bob {'x ' * 200}{tok}"), (12, f"postgres://db.example:5432 {tok}"), (13, "https://a.example https://b.example"),
        (14, f"https://a.example secret=abcdefg user_id=42x {key} {tok}"), (14, "x"), (None, f"token={hx}"), (15, "token=abcdef " * 3000),
        (16, ("user=abc " + tok + " ") * 400), (17, "ſecret=abcdef"),
    ]
    bits = ["user=ann ", tok + " ", hx + " ", "https://h.example/ ", "token: zz9zz9 ", "w " * 40, "w " * 100, "é ", key + " ", "AKIA ", "pass "]
    return rows + [(100 + i, "".join(rng.choice(bits) for _ in range(rng.randrange(12)))) for i in range(120)]


def test_secrets(spark):
    out = secret_scan.digest(secret_scan.secret_scan(docs(spark, secret_rows()))).collect()
    want = sorted(((i, text_of(brute_linked(t)), sha(text_of(brute_secrets(t)))) for i, t in secret_rows()), key=repr)
    assert sorted(((r["doc_id"], r["spans"], r["base_sha256"]) for r in out), key=repr) == want
    for r in out:
        kinds = [s.split(":")[0] for s in r["spans"].split(",") if s]
        assert [r[f"n_{k}"] for k in secret_scan.BASE] == [kinds.count(k) for k in secret_scan.BASE]
    assert secret_scan.secret_scan(docs(spark, [])).count() == 0


def test_secret_query(spark):
    every = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((r["doc_id"], r["spans"]) for r in registry.QUERIES["op8_secret_scan"](spark, SF).collect())
    assert got == sorted((i, text_of(brute_linked(t))) for i, t in every)


def luhn(digits):
    odd = [int(d) for d in digits[::-1]]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(odd)) % 10 == 0


def brute_pii(text):
    text = text or ""
    n = lambda s: len(re.sub("[^0-9]", "", s))
    found = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= n(m[0]) <= 19 and luhn(re.sub("[^0-9]", "", m[0]))]
    found += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= n(m[0]) <= 15]
    return found


def pii_rows():
    rng = random.Random(9)
    rows = [
        (1, None), (2, ""), (3, "a@b.c@d.e x.y+z@q-r.example.com."), (4, "a@b.cd_x@y.zz"), (5, "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255"),
        (6, "4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111"), (7, "+1 (743) 555-3824. +12 +1234567 +123456789012345678"), (8, "é" * 30 + " é@b.c a@b.co"),
        (9, "." * 3000 + "@x.y"), (10, "a" * 3000 + "@ b"), (11, "1" * 3000), (12, "a@b" + ".c" * 20_000), (13, "1.1.1.1 " * 2000), (14, "@@ a@@b.c"), (14, "x"),
        (None, "me@x.org"), (15, "0" * 16), (16, "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7"),
    ]
    bits = ["a", "b@", "@c.d", ".", "1", "23", " ", "-", "+", "(", ")", "x@y.z", "1.2.3.4", "4111111111111111", "é", "+49 30 123456", "_", "%"]
    return rows + [(100 + i, "".join(rng.choice(bits) for _ in range(rng.randrange(25)))) for i in range(400)]


def check_pii(rows, out):
    want = sorted(((i, sha(text_of(brute_pii(t)))) for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["base_sha256"]) for r in out), key=repr) == want
    for r in out:
        kinds = [s.split(":")[0] for s in r["spans"].split(",") if s]
        assert [r[f"n_{k}"] for k in pii.BASE] == [kinds.count(k) for k in pii.BASE]


def test_pii(spark):
    check_pii(pii_rows(), pii.digest(pii.find_pii(docs(spark, pii_rows()))).collect())
    assert pii.find_pii(docs(spark, [])).count() == 0


def test_pii_query(spark):
    every = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_pii(every, registry.QUERIES["op10_pii"](spark, SF).collect())


def test_added_kinds_need_checksum_or_context(spark):
    rows = [
        (1, "IBAN DE89370400440532013000 ok"), (2, "IBAN DE89370400440532013001 no"), (3, "my ssn is 123-45-6789"), (4, "part 123-45-6789 of"),
        (5, "call (743) 555-3824 now"), (6, "ratio 743 555-3824"), (7, "tel +1 (743) 555-3824"),
    ]
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find_pii(docs(spark, rows))).collect()}
    assert got == {1: "iban:5:27", 2: "", 3: "national:10:21", 4: "", 5: "local:5:19", 6: "", 7: "phone:4:21"}
    scored = {r["doc_id"]: [round(s["score"], 2) for s in r["found"]] for r in pii.find_pii(docs(spark, rows)).collect()}
    assert scored[1] == [1.0] and scored[3] == [0.6] and scored[7] == [1.0]


def test_prefix_sums(spark):
    rng = random.Random(0)
    for n in (0, 1, 2, 5, 16, 17, 500):
        v = [rng.randrange(9) for _ in range(n)]
        df = spark.createDataFrame([(v,)], "v array<int>")
        assert df.select(spans.prefix_sums(F.col("v"))).first()[0] == [sum(v[:i]) for i in range(n)]


def test_account_numbers_in_groups(spark):
    rows = [
        (1, "IBAN DE89 3704 0044 0532 0130 00 ok"), (2, "DE89-3704-0044-0532-0130-00"), (3, "DE89 3704 0044 0532 0130 01"),
        (4, "BE68 5390 0754 7034 BANK GB82 WEST 1234 5698 7654 32 BIC"), (5, "NO12 34 DE89 3704 0044 0532 0130 00"),
        (6, "DE89  3704 0044 0532 0130 00"), (7, "DE89370400440532013000 GB82WEST12345698765432"),
    ]
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find_pii(docs(spark, rows))).collect()}
    iban = {i: ",".join(x for x in s.split(",") if x.startswith("iban")) for i, s in got.items()}
    assert iban == {1: "iban:5:32", 2: "iban:0:27", 3: "", 4: "iban:0:19,iban:25:52", 5: "iban:8:35", 6: "", 7: "iban:0:22,iban:23:45"}


def test_a_text_of_very_many_spans_takes_seconds(spark):
    """Half a megabyte of strong and weak parts in turn: a sweep over them, no comparison of all with all."""
    import time

    text = "".join(f"user=u{i} password=Ab{i:06d}x AKIAABCDEFGH{i:08d} Zz9yXw8vUt7sRq6pOn5m{i}A https://h{i}.example/ " for i in range(5_000))
    df = spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")
    began = time.perf_counter()
    got = {r["doc_id"]: r for r in secret_scan.digest(secret_scan.secret_scan(df)).collect()}
    assert got[1]["n_assign"] == 5_000 and got[1]["n_access"] == 5_000 and got[2]["spans"] == ""
    assert time.perf_counter() - began < 60
