import hashlib
import random
import re
import string

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tarn.llm import pii

from .helpers import documents

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits)))
    return total % 10 == 0


def brute(text):
    found, n = [], dict.fromkeys(PATTERNS, 0)
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]()
            if good:
                n[kind] += 1
                found.append((m.start(), rank, m.end(), kind))
    text = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))
    return n, text


def check(spark, texts):
    got = {r["doc_id"]: r for r in pii.report(documents(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        n, text = brute(t)
        r = got[i]
        assert {k: r[f"n_{k}"] for k in n} == n, t
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), t
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(",")), t


HARD = [
    None, "", "a@b.c", "x a@b.c_d@e.f y", "a@b@c.d", "a@b.c@d.e.", "@a.b", "a@-.-", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1 255.255.255.255 007.0.0.1", "1..2.3.4.5", "99999999999999999999.1.1.1", "0000000255.1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111 x 4111  1111", "4111111111111112", "+1 (017) 555-7713 and +12", "+1+22 333 444 5555 6", "++1 234 567 8901", "é😀a@b.c é 1.2.3.4😀+1 (017) 555-7713", "1" * 3000, "a" * 50_000 + "@", "a." * 3000 + "@b.c",
    "1.2.3.4" * 50, " ".join("u%d@h.example" % i for i in range(3000)), "a 12 " * 2048, "12 a " * 255 + "12", "12 a " * 256,
]


def test_hard_cases(spark):
    check(spark, HARD)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from("ab.@+-_() 01259é😀"), max_size=40), min_size=100, max_size=200))
def test_against_brute_force(spark, texts):
    check(spark, texts)


def test_added_kinds(spark):
    texts = ['token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" x', "call (555) 123-4567 now", "ssn: 123-45-6789", "iban DE89370400440532013000", "the page has 2024 0301 123 lines", "abcdefghijklmnopqrstuvwxyzabcdef", "ip 2001:db8:85a3:8d3:1319:8a2e:370:7348", "at 12:30:45"]
    got = [r["spans"] for r in pii.report(documents(spark, list(enumerate(texts)))).orderBy("doc_id").collect()]
    assert [g.split(":")[0] for g in got] == ["secret", "local_phone", "national_id", "iban", "", "", "ipv6", ""]


def test_redaction(spark):
    rows = [(0, "mail é a@b.c, or 1.2.3.4!"), (1, None), (2, "nothing"), (2, "nothing"), (None, "x@y.zz")]
    df = documents(spark, rows)
    out = pii.redact(df, "n_chars")
    assert out.columns == df.columns
    got = {(r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()}
    assert got == {(0, "mail é [EMAIL], or [IP]!", 24), (1, None, None), (2, "nothing", 7), (None, "[EMAIL]", 7)}
    assert pii.report(documents(spark, [])).collect() == []


def test_native_plan(spark):
    plan = pii.redact(documents(spark, [(0, "a")])).unionByName(documents(spark, [(0, "a")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_trees_fit_their_examples():
    booster, limits = pii.model()
    x, y = pii._examples(seed=7)
    chosen = [m > limits[pii.KINDS[int(k)]] for m, k in zip(booster.margin(x), x[:, 0], strict=True)]
    right = sum(c == bool(t) for c, t in zip(chosen, y, strict=True)) / len(y)
    assert right > 0.97


@pytest.mark.parametrize("value", ["DE89370400440532013000", "DE89370400440532013001"])
def test_iban_check(spark, value):
    from pyspark.sql import functions as F

    got = spark.range(1).select(pii._checked_column("iban", F.lit(value)).alias("x")).first()["x"]
    assert got == pii._checked("iban", value)


def test_secrets_of_any_length(spark):
    r = random.Random(3)
    key = lambda n: "".join(r.choices(string.ascii_letters + string.digits + "_-", k=n))
    keys = [key(n) for n in (40, 150, 200, 201, 1000, 60_000)] + [f"{key(36)}.{key(n)}.{key(43)}" for n in (60, 300, 2000)]
    texts = [f'token = "{k}" x' for k in keys] + ["the run " + key(300) + " y", "a" * 50_000, ".".join(["b" * 20] * 20_000)]
    got = [x["spans"] for x in pii.report(documents(spark, list(enumerate(texts)))).orderBy("doc_id").collect()]
    assert got == [f"secret:9:{9 + len(k)}" for k in keys] + [""] * 3
    redacted = [x["text"] for x in pii.redact(documents(spark, list(enumerate(texts)))).orderBy("doc_id").collect()]
    assert redacted == ['token = "[SECRET]" x'] * len(keys) + texts[len(keys) :]


def test_assignments_and_padding(spark):
    r = random.Random(6)
    key = lambda n: "".join(r.choices(string.ascii_letters + string.digits, k=n))
    h = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    secrets = {f"token={h}": (6, 46), f"api_key = sk-{key(40)}": (10, 53), f"export ACCESS_KEY={key(40)}": (18, 58), f"password={key(42)}==": (9, 53), f"Bearer {key(36)}.{key(80)}.{key(43)}": (7, 168)}
    plain = [f"commit {h}", f"sha256:{h}", "https://host.example/some/long/path/of/words/here", "some_long_function_name_of_words", "-" * 60, "x=aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    got = [x["spans"] for x in pii.report(documents(spark, list(enumerate([*secrets, *plain])))).orderBy("doc_id").collect()]
    assert got == [f"secret:{a}:{b}" for a, b in secrets.values()] + [""] * len(plain)


def test_overlaps_against_brute_force(spark):
    from pyspark.sql import functions as F

    r = random.Random(2)
    rows = []
    for i in range(300):
        base = sorted((a, a + r.randint(1, 12)) for a in (r.randrange(60) for _ in range(r.randint(0, 5))))
        more, at = [], 0
        for _ in range(r.randint(0, 6)):
            at += r.randint(0, 8)
            more.append((at, at + r.randint(1, 5)))
            at = more[-1][1]
        rows.append((i, base, more))
    kind = "array<struct<start:bigint,end:bigint>>"
    df = spark.createDataFrame(rows, f"i int, base {kind}, more {kind}")
    spans = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), F.lit(0).alias("rank"), x["end"].alias("end"), F.lit("k").alias("kind"), x["start"].alias("from"), x["end"].alias("to")))
    got = df.withColumns({"a": spans("base"), "b": spans("more")}).select("i", pii._bound(F.col("a"), pii._joined_by(F.col("b"))).alias("x")).collect()
    for g in got:
        _, base, more = rows[g["i"]]
        want = base + [m for m in more if not any(a < m[1] and m[0] < b for a, b in base)]
        assert sorted((x["start"], x["end"]) for x in g["x"]) == sorted(want)


def test_redaction_is_near_linear(spark):
    import time

    def seconds(n):
        text = " ".join(f"u{i}@h.example é" for i in range(n))
        df = documents(spark, [(0, text)])
        began = time.perf_counter()
        out = pii.redact(df, "n_chars").first()["text"]
        took = time.perf_counter() - began
        assert out == " ".join(["[EMAIL] é"] * n)
        return took

    seconds(100)
    assert seconds(40_000) < 8 * seconds(10_000) + 5
