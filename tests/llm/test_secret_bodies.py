"""The whole of a secret is covered, not only its first line."""

import random

from riskspark.llm import secret_scan


def test_key_bodies_and_long_logins_are_redacted(spark):
    r = random.Random(8)
    line = lambda n=64: "".join(r.choice("ABCDEFGHijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    body = lambda n: "\n".join(line() for _ in range(n))
    key = lambda kind, n: f"-----BEGIN {kind}PRIVATE KEY-----\n{body(n)}\n-----END {kind}PRIVATE KEY-----"
    head = "-----BEGIN RSA PRIVATE KEY-----"
    dashed = f"{head}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A\n\n{body(3)}\n-----END RSA PRIVATE KEY-----"
    m = "[SECRET]"
    texts = [
        (f"a {key('', 20)} b {key('RSA ', 30)} c", f"a {m} b {m} c"),
        (f"a {key('OPENSSH ', 9000)} b", f"a {m} b"),
        (f"a {dashed} b", f"a {m} b"),
        (f"a {head} cut - here -- {key('EC ', 4)} b", f"a {m} cut - here -- {m} b"),
        (f"a {head} " + "- x " * 50_000, f"a {m} " + "- x " * 50_000),
        (f"see https://user:{line(200).replace('/', '+')}@host/x and https://{'u' * 90}:pass1@host", f"see {m}host/x and {m}host"),
        ("-----BEGIN CERTIFICATE-----\nabc\n-----END CERTIFICATE-----", "-----BEGIN CERTIFICATE-----\nabc\n-----END CERTIFICATE-----"),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {x["doc_id"]: x["text"] for x in secret_scan.redacted(df).collect()}
    assert [got[k] == want for k, (_, want) in enumerate(texts)] == [True] * len(texts), {k: got[k][:300] for k in got}
