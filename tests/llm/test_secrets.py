"""The trigram index gives exactly what scanning every text with every rule gives."""

import hashlib
import re

from beaconflow.llm import secrets
from beaconflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    out = []
    for i, (kind, pattern, flags, group, least) in enumerate([
            ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6),
            ("access", "AKIA[A-Z0-9]+", 0, 0, 20), ("hex", "[0-9a-f]+", 0, 0, 24),
            *[(r.kind, r.pattern, r.flags, r.group, r.least) for r in secrets.MORE_RULES]]):
        out += [(m.start(), i, m.end(), kind) for m in re.finditer(pattern, text, flags) if m.end(group) - m.start(group) >= least]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


def base_of(spans):
    return [s for s in spans if s.split(":")[0] in ("assign", "access", "hex")]


def test_query_equals_scanning_everything(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op5_secret_scan"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        want = brute(docs[r.doc_id])
        assert r.spans == ",".join(want)
        assert r.base_sha256 == hashlib.sha256(",".join(base_of(want)).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(w.startswith(k + ":") for w in want) for k in ("assign", "access", "hex")]
    assert sum(r.n_assign + r.n_access + r.n_hex for r in got) > 0


ODD = [None, "", "ab", "PassWord = 'abcdef'", "password=token:abcdefgh", "é token:\"ABCDEF.=/+\"", "AKIA" + "Z" * 16, "xAKIA" + "9" * 15,
       "0123456789abcdef01234567", "ghp_" + "a" * 36, "API_KEY:  sk123456 apikey=short", "ſecret=abcdef toKen=abcdef",
       "xoxb-1234567890-abc https://me:pw@host/", "-----BEGIN RSA PRIVATE KEY-----", "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12,
       "word " * 30000 + "secret=abcdef1"]


def test_odd_texts_null_and_repeated_keys(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(3, "nothing here", "y"), (None, "token=abcdef", "z"), (None, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, k string")
    got = secrets.find_secrets(df, keep=("k",)).select("doc_id", "k", secrets.span_text().alias("s")).collect()
    assert sorted(map(str, got)) == sorted(str(type(got[0])(doc_id=i, k=k, s=",".join(brute(t)))) for i, t, k in rows)
    assert secrets.find_secrets(df.limit(0)).collect() == []


def test_every_rule_but_hex_has_mandatory_trigrams():
    assert [r.kind for r in secrets.RULES if not secrets.trigram_query(r)] == ["hex"]
    q = secrets.trigram_query(secrets.BASE_RULES[1])
    assert q == [frozenset({frozenset({"aki", "kia"})})]


def test_redaction(spark):
    rows = [(1, "a token=abcdef b", 5), (2, None, 0), (3, "0123456789abcdef01234567 x secret: 0123456789abcdef01234567", 9), (4, "clean", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rules int")
    got = {r.doc_id: (r.text, r.rules) for r in secrets.redact(df).collect()}
    assert got == {1: ("a [SECRET] b", 5), 2: (None, 0), 3: ("[SECRET] x [SECRET]", 9), 4: ("clean", 1)}
