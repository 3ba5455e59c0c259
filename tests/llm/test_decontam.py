"""Windows, fingerprints and candidates of decontamination against brute force."""

import random
from collections import Counter

from pyspark.sql import functions as F

from folioforge.llm import decontam


def grams(w, width=5):
    return Counter(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def brute(rows, items):
    want = {}
    for d, t in rows:
        w = (t or "").lower().split()
        for i, b in items:
            b = (b or "").lower().split()
            if not grams(w, min(5, len(b) or 1)).keys() & grams(b, min(5, len(b) or 1)).keys():
                continue
            for s in range(max(1, len(w) - len(b) + 1)) if w and b else ():
                x, y = (grams(v, min(5, len(b))) for v in (w[s : s + len(b)], b))
                found = sum((x & y).values()) / sum((x | y).values())
                if found >= 0.8 - 1e-12 and found > want.get((d, i), (0,))[0]:
                    want[d, i] = (found, s, len(b))
    return {(d, i, round(f, 6), s, n) for (d, i), (f, s, n) in want.items()}


def test_against_brute_force(spark):
    rng = random.Random(11)
    words = [f"v{k}" for k in range(50)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(k, some(rng.choice([5, 6, 30, 30, 44, 60, 200]))) for k in range(24)] + [(90, ["a"] * 40), (91, some(3))]
    rows = []
    for k in range(90):
        b = list(rng.choice(items)[1])
        for _ in range(rng.choice([0, 0, 1, 2, 4])):  # words changed, dropped, added, or an end cut off
            at = rng.randrange(len(b))
            b = rng.choice([b[:at] + ["new"] + b[at + 1 :], b[:at] + b[at + 1 :], b[:at] + ["new"] + b[at:], b[: max(1, len(b) - len(b) // 9)]])
            b = b or ["x"]
        rows.append((k % 80, " ".join(some(rng.choice([0, 3, 400])) + b + some(rng.choice([0, 3, 60])))))
    rows += [(500, "a " * 700), (501, "x"), (502, None), (503, ""), (None, " ".join(items[3][1])), (None, "clean text of no item at all here"), rows[7], rows[7]]
    texts = [(i, " ".join(b)) for i, b in items] + [(92, None), (93, " "), (94, " ".join(items[0][1]))]
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, item_id string, n_words int").repartition(5)
    bench = spark.createDataFrame(texts, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.similarity, r.start_word, r.n_words) for r in decontam.contaminated(docs, bench).collect()}
    # Of one id the best window of all its texts counts, so texts that share an id are judged as one set of windows.
    want = brute(rows, texts)
    lost = {x[:2] for x in want} - {x[:2] for x in got}
    assert not {x[:2] for x in got} - {x[:2] for x in want}
    assert len(lost) <= 0.01 * len(want), lost
    assert len(got & want) >= 0.99 * len(want)
    assert decontam.contaminated(docs.limit(0), bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_fingerprints_and_candidates(spark):
    rng = random.Random(12)
    lists = [[rng.getrandbits(64) - 2**63 for _ in range(n)] for n in (1, 2, 7, 126, 127, 128, 300, 32767, 32768)]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k int, h array<long>").select("k", F.expr(decontam.simhash("h")).alias("fp")).collect()
    for k, fp in got:
        assert fp % 2**64 == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in lists[k]) > len(lists[k]))
    base = [rng.getrandbits(64) for _ in range(6)]
    near = [(k, x ^ sum(1 << b for b in rng.sample(range(64), d))) for k, x in enumerate(base) for d in range(0, 30)]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    bench = spark.createDataFrame([(30 + k % 2, k, signed(x)) for k, x in enumerate(base)], "m int, item long, ifp long")
    asked = spark.createDataFrame([(30 + k % 2, signed(x)) for k, x in near], "m int, wfp long")
    want = {(30 + k % 2, signed(x), i) for k, x in near for i, y in enumerate(base) if i % 2 == k % 2 and (x ^ y).bit_count() <= 19}
    assert {(r.m, r.wfp, r.item) for r in decontam.candidates(asked, bench).collect()} == want
