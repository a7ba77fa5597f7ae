"""Matches of recordings that the search has to return whole."""

import random

import numpy as np
from pyspark.sql import functions as F

from riskspark.llm import audio_fingerprint as A


def words(r, n):
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(3)) for _ in range(n)]


def matches(spark, texts, *asked):
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "id long, text string")
    found = A.search(A.fingerprint(df, ["id"], "text", decode=A.played), F.col("id").isin(*asked), ["id"])
    return {(x["id"], x["match_class"]["id"]): x for x in found.collect()}


def test_more_near_copies_than_ten(spark):
    r = random.Random(3)
    base = words(r, 80)
    texts = [base] + [base[:k] + words(r, 1) + base[k + 1 :] for k in range(3, 78, 3)]
    found = matches(spark, texts, 0)
    assert {m for _, m in found} == set(range(26))
    assert sorted(x["rank"] for x in found.values()) == list(range(1, 27))


def test_passage_in_other_surroundings(spark):
    r = random.Random(4)
    passage = words(r, 50)
    texts = [words(r, 90) + passage + words(r, 90), words(r, 120) + passage + words(r, 60), words(r, 230)]
    found = matches(spark, texts, 0, 1)
    assert set(found) == {(0, 0), (0, 1), (1, 1), (1, 0)}
    assert found[0, 1]["offset"] == 30 and found[1, 0]["offset"] == -30
    assert 20 <= found[0, 1]["overlap"] <= 60 and found[0, 1]["votes"] >= 20 and found[0, 1]["bit_errors"] <= 0.2


def test_full_alignment_before_a_short_chance_one():
    r = np.random.default_rng(5)
    own = r.integers(0, 1 << 32, 200, dtype=np.uint32)
    query = own.copy()
    query[::3] ^= np.uint32(1)  # one bit of 32 at every third place
    own = np.concatenate([own, r.integers(0, 1 << 32, 20, dtype=np.uint32), query[:6]])  # at offset 220 six places are equal
    block = lambda name, x: A.pa.table({"class_id": [name], "items": [x.tobytes()]})
    ((name, match, offset, overlap, votes, errors),) = A._grid(block("m", own), block("q", query))
    assert (name, match, offset, overlap, votes) == ("q", "m", 0, 200, 133) and errors < 0.02


def test_matches_are_those_of_all_offsets():
    """Against a twin that judges every offset of every pair, position by position."""
    r = np.random.default_rng(6)
    make = lambda n: r.integers(0, 1 << 32, n, dtype=np.uint32)
    shared, rows = make(30), []
    for k in range(12):
        noisy = shared[k % 5 : 30 - k] ^ (np.uint32(1) << r.integers(0, 32, 30 - k - k % 5).astype(np.uint32)) * (r.random(30 - k - k % 5) < 0.3)
        rows.append(np.concatenate([make(3 * k), noisy.astype(np.uint32), make(40 - 3 * k)]))
    rows += [make(50), shared[:7], rows[0][10:]]

    def judge(x, y, least, votes):
        wrong = [int(a ^ b).bit_count() / 32 for a, b in zip(x.tolist(), y.tolist())]
        if sum(wrong) <= A.MOST_ERRORS * len(wrong):
            runs = [(0, len(wrong))]
        else:
            near = [wrong[max(0, i - A.OVERLAP // 2) : i - A.OVERLAP // 2 + A.OVERLAP] for i in range(len(wrong))]
            good = [sum(w) <= A.MOST_ERRORS * len(w) for w in near]
            runs = [(i, j) for i in range(len(good)) for j in range(i + 1, len(good) + 1) if all(good[i:j]) and not any(good[i - 1 : i] if i else []) and not any(good[j : j + 1])]
        runs = [(j - i, wrong[i:j].count(0), sum(wrong[i:j]) / (j - i)) for i, j in runs if j - i >= least and wrong[i:j].count(0) >= votes]
        return max(runs, key=lambda x: x[0], default=None)

    want = {}
    for q, b in enumerate(rows):
        for m, a in enumerate(rows):
            for off in range(-len(b) + 1, len(a)):
                x, y = a[max(0, off) : off + len(b)], b[max(0, -off) :]
                n = min(len(x), len(y))
                fit = judge(x[:n], y[:n], min(A.OVERLAP, len(a), len(b)), min(A.VOTES, len(b)))
                if fit:
                    want[q, m] = min(want.get((q, m), (1,)), (-fit[1], -fit[0], round(fit[2], 9), off))
    block = A.pa.table({"class_id": [str(k) for k in range(len(rows))], "items": [x.tobytes() for x in rows]})
    got = {(int(q), int(m)): (-v, -n, round(e, 9), off) for q, m, off, n, v, e in A._grid(block, block)}
    assert got == want and len(got) > 100
