import random
import re

import numpy as np

from codeloam.llm import leaks

DOC = "doc_id bigint, text string, item_id bigint, similarity double"
ITEM = "item_id bigint, text string, doc_id bigint"
WORDS = [f"w{k}" for k in range(400)]


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, 5, 0.5) for i, t in docs], DOC)
    got = leaks.leaked_items(d, spark.createDataFrame([(i, t, 3) for i, t in items], ITEM)).collect()
    return {(r.doc_id, r.item_id): r for r in got}


def brute(docs, items):
    runs = lambda t: {tuple(w[k : k + 10]) for w in [re.findall("[a-z0-9]+", (t or "").lower())] for k in range(len(w) - 9)}
    return {(d, i) for d, t in docs for i, u in items if runs(t) & runs(u)}


def test_against_brute_force(spark):
    rng = random.Random(1)
    items = [(k, " ".join(rng.choices(WORDS, k=rng.randrange(5, 60)))) for k in range(20)]
    docs = []
    for k in range(60):
        w = rng.choices(WORDS, k=rng.randrange(0, 200))
        if k % 3 == 0:
            src = items[rng.randrange(20)][1].split()
            n = rng.randrange(6, 16)
            at = rng.randrange(max(1, len(src) - n))
            w[5:5] = src[at : at + n]
        docs.append((k, ", ".join(w).upper() if k % 2 else "\n".join(w)))
    got = {k for k, r in run(spark, docs, items).items() if r.shared_runs}
    assert got == brute(docs, items) and got


def test_nine_words_are_no_passage_and_ten_are(spark):
    item = " ".join(WORDS[:30])
    got = run(spark, [(1, " ".join(WORDS[3:12])), (2, " ".join(WORDS[3:13])), (3, item)], [(7, item)])
    assert (1, 7) not in got or not got[1, 7].shared_runs
    assert got[2, 7].shared_runs == 1 and got[2, 7].longest_run == 10
    assert got[3, 7].longest_run == 30 and got[3, 7].similarity == 1.0


def test_nulls_empty_long_and_repeated(spark):
    item = " ".join(WORDS[:20])
    long = "x " * 300_000 + item
    docs = [(1, None), (2, ""), (3, long), (3, long), (None, item), (4, "short")]
    got = leaks.leaked_items(spark.createDataFrame([(i, t, 5, 0.5) for i, t in docs], DOC), spark.createDataFrame([(7, item, 1), (8, None, 1), (None, item, 1), (9, "", 1)], ITEM)).collect()
    assert sorted((r.doc_id or -1, r.item_id) for r in got) == [(-1, 7), (3, 7), (3, 7)]
    assert run(spark, [], [(7, item)]) == {} and run(spark, [(3, item)], []) == {}


def test_index_guarantees_the_radius():
    rng = np.random.default_rng(0)
    text = " ".join(WORDS[k] for k in rng.integers(0, 400, 200))
    index = leaks.ItemIndex([(1, text)])
    q = index.prints.copy()
    for k in range(len(q)):
        for b in rng.choice(64, leaks.RADIUS, replace=False):
            q[k] ^= np.uint64(1) << np.uint64(b)
    qs, ws = index.near(q)
    assert set(range(len(q))) <= {int(a) for a, b in zip(qs, ws) if a == b}
    assert len({(a, b) for a, b in zip(qs.tolist(), ws.tolist())}) == len(qs)
