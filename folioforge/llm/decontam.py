"""Benchmark decontamination by SimHash windows and multi-index Hamming search (DataFrame functions only).

A document is contaminated by an item if some window of as many words as the
item has (the whole document, if that is shorter) reaches a weighted shingle
similarity of at least ``similarity``: shingles of five words, A-Z lower-cased,
each weighted by how often it occurs (sum of minima over sum of maxima).

1. Anchors. Every shingle of every text is looked up among the shingles of all
   items, which tells only of what sizes the items are that hold it. A window of
   m words is laid only where it holds at least ``similarity`` times as many
   anchors of size m as an item of that size has shingles: nothing that could
   match is lost, and which item it may be is not known yet.
2. Fingerprints. Each window gets a 64-bit SimHash of its shingles.
3. Candidates. Fingerprints are cut into four blocks of 16 bits; within
   ``radius`` bits at least one block differs in at most ``radius // 4`` bits, so
   items are filed under every block value that near their own, and windows look up
   the items of their size under their own four block values. All fingerprints
   within the radius are found; no others are kept.
4. Verification. The candidates' windows keep the exact similarity.

At a similarity of 0.8 two fingerprints differ in about 10 of 64 bits, with a
deviation of 3; a radius of 19 leaves about one in a thousand such borderline
windows unfound, and none that are equal.

Shingles are compared as 64-bit hashes. Edge cases: null or blank texts and
items without words match nothing; an item under five words is looked for as a run
of its words, and equal shorter runs are found whole, so they need no fingerprint;
rows that share an id (or have none) are searched as texts of their own, and an id
is reported once with each item that any of its texts holds; equal rows count once;
equal items are all reported; a null id is reported as null; extra columns are
ignored; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import BROADCAST_ROWS, SPACE, lower_ascii, materialize, small, table, words_of

WIDTH, SIMILARITY, RADIUS = 5, 0.8, 19
#: Blocks of a fingerprint, and starts of windows that share one slice of a text.
BLOCKS, CHUNK = 4, 256


def _worded(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, w, n: the words of ``text`` and their number, of rows that have words."""
    return rows.select(*keys, words_of(lower_ascii(F.col("text"))).alias("w")).select(*keys, "w", F.size("w").alias("n")).where("n > 0")


def _hashes(width: int = WIDTH) -> Column:
    """One hash for each run of ``width`` words of ``w`` (n at least ``width``)."""
    return F.transform(F.sequence(F.lit(0), F.col("n") - width), lambda p: F.xxhash64(*[F.get("w", p + k) for k in range(width)]))


def simhash(h: str) -> str:
    """SQL of the SimHash of an array of hashes: a bit is 1 if it is set in over half of them.

    Counters lie side by side in longs (lanes of 8, 16 or 32 bits, by the number of
    hashes). A lane starts ``2**(lane-1) - 1 - n // 2`` above zero, so its top bit is set
    where it counts more than n // 2; the uppermost starts ``n // 2 + 1`` below zero, so the sign tells the same.
    """
    half = f"(size({h}) div 2)"

    def by(lane: int) -> str:
        ones, uppermost = sum(1 << k for k in range(0, 64, lane)), 1 << (64 - lane)
        start = f"({(1 << (lane - 1)) - 1}L - {half}) * {ones - uppermost}L - ({half} + 1L) * {uppermost}L"
        counts = (f"aggregate({h}, {start}, (a, x) -> a + (shiftrightunsigned(x, {b}) & {ones}L))" for b in range(lane))
        return " | ".join(f"shiftleft(shiftrightunsigned({c} ^ shiftleft(1L, 63), {lane - 1}) & {ones}L, {b})" for b, c in enumerate(counts))

    return f"CASE WHEN size({h}) < {1 << 7} THEN {by(8)} WHEN size({h}) < {1 << 15} THEN {by(16)} ELSE {by(32)} END"


def _bag_overlap(a: Column, b: Column) -> Column:
    """Sum of the minima of occurrences; sets take the short way."""
    distinct = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    slow = F.aggregate(
        F.array_intersect(a, b), F.lit(0), lambda t, h: t + F.least(F.size(F.filter(a, lambda x: x == h)), F.size(F.filter(b, lambda x: x == h)))
    )
    return F.when(distinct, F.size(F.array_intersect(a, b))).otherwise(slow)


def _blocks(fp: str) -> Column:
    """The four 16-bit blocks of a fingerprint, each with its number above."""
    return F.array(*[F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF)).cast("int").bitwiseOR(F.lit(k << 16)) for k in range(BLOCKS)])


def _near(block: Column, flips: int) -> Column:
    """All block values that differ from one in at most ``flips`` bits."""
    masks = ",".join(str(m) for m in range(1 << 16) if m.bit_count() <= flips)
    return F.transform(F.split(F.lit(masks), ",").cast("array<int>"), lambda m: block.bitwiseXOR(m))


def _short(docs: DataFrame, items: DataFrame) -> DataFrame | None:
    """The first run of words equal to an item under five words, of each pair; None without such items."""
    short = items.where(F.col("n") < WIDTH)
    widths = sorted(r.n for r in short.select("n").distinct().collect())  # at most four
    out = None
    for m in widths:
        known = small(short.where(F.col("n") == m).select("item", "item_id", _hashes(m).alias("h")).select("item", "item_id", F.get("h", F.lit(0)).alias("h")))
        placed = _worded(docs, "doc_id").where(F.col("n") >= m).select("doc_id", F.posexplode(_hashes(m)).alias("p", "h"))
        found = placed.join(known, "h").groupBy("doc_id", "item", "item_id").agg(F.min("p").alias("s"))
        found = found.select("doc_id", "item_id", F.lit(1.0).alias("similarity"), F.col("s").cast("long").alias("start_word"), F.lit(m).cast("long").alias("n_words"), F.lit(0).cast("long").alias("distance"))
        out = found if out is None else out.unionByName(found)
    return out


def windows(docs: DataFrame, bench: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(parts, windows): slices of the texts that hold enough anchors, and start and fingerprint of every window in them.

    A part is (doc_id, dg, m, c, part): the shingle hashes from start ``c * CHUNK`` on, as many as its windows need.
    """
    known = small(bench.select("m", F.explode("ih").alias("h")).distinct())
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("dg"))
    hashed = _worded(keyed, "doc_id", "dg").where(F.col("n") >= WIDTH)
    anchors = hashed.select("doc_id", "dg", "n", F.posexplode(_hashes()).alias("p", "h")).join(known, "h")
    k = F.col("m") - (WIDTH - 1)
    least = F.ceil(k * F.lit(similarity) - 1e-9).cast("int")
    # Positions of one text: at most as many as it has words.
    runs = anchors.groupBy("doc_id", "dg", "n", "m").agg(F.array_sort(F.collect_set("p")).alias("ps")).where(F.size("ps") >= least)
    runs = materialize(runs.withColumn("t", least), "decontam-anchors")
    # Starts s of windows over p[i] .. p[i+t-1]: the window's shingles are s .. s+k-1; one too near the end names the last window.
    spans = F.transform(
        F.sequence(F.lit(0), F.size("ps") - F.col("t")),
        lambda i: F.struct(F.greatest(F.get("ps", i + F.col("t") - 1) - k + 1, F.lit(0)).alias("a"), F.get("ps", i).alias("b")),
    )
    last = F.greatest(F.col("n") - F.col("m"), F.lit(0))
    starts = runs.select("doc_id", "dg", "m", last.alias("last"), F.explode(F.filter(spans, lambda x: x.a <= x.b)).alias("x"))
    starts = starts.select("doc_id", "dg", "m", F.explode(F.sequence(F.least("x.a", "last"), F.least("x.b", "last"))).alias("s"))
    chunks = starts.groupBy("doc_id", "dg", "m", F.floor(F.col("s") / CHUNK).cast("int").alias("c")).agg(F.collect_set("s").alias("ss"))
    chunks = chunks.select(F.col("doc_id").alias("id"), F.col("dg").alias("digest"), "m", "c", "ss")
    hit = runs.select(F.col("doc_id").alias("id"), F.col("dg").alias("digest")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("dg") == F.col("digest"))
    texts = _worded(keyed.join(hit, same, "left_semi").dropDuplicates(["doc_id", "dg"]), "doc_id", "dg").select("doc_id", "dg", _hashes().alias("hs"))
    parts = texts.join(chunks, same).select("doc_id", "dg", "m", "c", "ss", F.slice("hs", F.col("c") * CHUNK + 1, CHUNK + k).alias("part"))
    parts = materialize(parts, "decontam-parts")
    cut = f"transform(ss, s -> named_struct('s', s, 'ws', slice(part, s - c * {CHUNK} + 1, m - {WIDTH - 1})))"
    made = parts.select("doc_id", "dg", "m", "c", F.explode(F.expr(f"transform({cut}, y -> named_struct('s', y.s, 'wfp', {simhash('y.ws')}))")).alias("x"))
    return parts, materialize(made.select("doc_id", "dg", "m", "c", "x.s", "x.wfp"), "decontam-windows")


def candidates(fingerprints: DataFrame, bench: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(m, wfp, item, ifp): all pairs of a window's and an item's fingerprint of one size within ``radius`` bits."""
    filed = bench.select("m", "item", "ifp", F.explode(_blocks("ifp")).alias("block")).select("m", "item", "ifp", F.explode(_near(F.col("block"), radius // BLOCKS)).alias("block"))
    asked = materialize(fingerprints.select("m", "wfp").distinct(), "decontam-asked")
    # The filed items are many more rows than Spark's estimate says and are never broadcast.
    found = small(asked, BROADCAST_ROWS // BLOCKS).select("m", "wfp", F.explode(_blocks("wfp")).alias("block"))
    return filed.hint("merge").join(found, ["m", "block"]).where(F.bit_count(F.col("wfp").bitwiseXOR(F.col("ifp"))) <= radius).select("m", "wfp", "item", "ifp").distinct()


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words, distance: the best window (then the earliest) of each pair found."""
    docs = docs.select("doc_id", "text")
    named = materialize(_worded(items.select("item_id", "text"), "item_id").withColumn("item", F.monotonically_increasing_id()), "decontam-words")
    bench = named.where(F.col("n") >= WIDTH).select("item", "item_id", F.col("n").alias("m"), _hashes().alias("ih"))
    bench = materialize(bench.withColumn("ifp", F.expr(simhash("ih"))), "decontam-items")
    parts, laid = windows(docs, bench, similarity)
    pairs = laid.join(candidates(laid, bench, radius), ["m", "wfp"]).select(F.col("doc_id").alias("id"), F.col("dg").alias("digest"), "m", "c", "s", "wfp", "item", "ifp")
    of = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("dg") == F.col("digest"))
    exact = parts.drop("ss").join(pairs, ["m", "c"]).where(of).join(bench.select("item", "item_id", "ih"), "item")
    exact = exact.withColumn("ws", F.slice("part", F.col("s") - F.col("c") * CHUNK + 1, F.col("m") - (WIDTH - 1)))
    exact = exact.select("doc_id", "item", "item_id", "m", "s", "ws", "ih", F.bit_count(F.col("wfp").bitwiseXOR(F.col("ifp"))).alias("distance"), _bag_overlap(F.col("ws"), F.col("ih")).alias("both"))
    exact = exact.withColumn("similarity", F.col("both") / (F.size("ws") + F.size("ih") - F.col("both"))).where(F.col("similarity") >= similarity - 1e-12)
    best = F.struct(F.col("similarity"), (-F.col("s")).alias("s"))
    out = exact.groupBy("doc_id", "item", "item_id").agg(F.max_by(F.struct("similarity", "s", "m", "distance"), best).alias("x"))
    out = out.select("doc_id", "item_id", F.round("x.similarity", 6).alias("similarity"), F.col("x.s").cast("long").alias("start_word"), F.col("x.m").cast("long").alias("n_words"), F.col("x.distance").cast("long").alias("distance"))
    short = _short(docs, named)
    return out if short is None else out.unionByName(short)


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every contaminated document with each item it holds."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("distance")


def oracle() -> str:
    """DuckDB SQL of query 4: all windows of all texts that hold enough of an item's shingles, and all runs of the words of a short item."""
    space = SPACE
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"list_filter(regexp_split_to_array({lower}, '{space}'), lambda x: x <> '')"
    grams = f"list_transform(range(0, k), lambda i: array_to_string(w[(i + 1)::BIGINT:(i + {WIDTH})::BIGINT], ' '))"
    k = f"CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - {WIDTH - 1}, 1) END"
    return f"""
WITH d0 AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
d AS (SELECT rid, doc_id, len(w) AS n, k, {grams} AS g FROM (SELECT *, {k} AS k FROM d0) WHERE k > 0),
i0 AS (SELECT item_id, {words} AS w FROM benchmark),
i AS (SELECT item_id, len(w) AS m, k, {grams} AS g FROM (SELECT *, {k} AS k FROM i0) WHERE len(w) >= {WIDTH}),
few AS (SELECT item_id, w AS iw, len(w) AS m FROM i0 WHERE len(w) BETWEEN 1 AND {WIDTH - 1}),
runs AS (SELECT doc_id, w, item_id, iw, m, unnest(range(0, len(w) - m + 1)) AS p FROM d0 JOIN few ON len(w) >= m),
dp AS (SELECT rid, unnest(range(0, k)) AS p, unnest(g) AS t FROM d),
ip AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest(g) AS t FROM i) GROUP BY ALL),
hit AS (SELECT rid, item_id, p, t, c FROM dp JOIN ip USING (t)),
cand AS (SELECT rid, item_id, min(p) AS lo, max(p) AS hi FROM hit JOIN (SELECT item_id, k FROM i) USING (item_id) GROUP BY rid, item_id, k HAVING count(*) >= {SIMILARITY} * k - 1e-9),
win AS (SELECT rid, item_id, d.n, i.m, i.k, unnest(range(greatest(lo - i.k + 1, 0), least(hi, greatest(n - m, 0)) + 1)) AS s FROM cand JOIN d USING (rid) JOIN i USING (item_id)),
cnt AS (SELECT win.rid, win.item_id, win.m, win.s, win.k, win.n, hit.t, least(count(*), any_value(hit.c)) AS shared FROM win JOIN hit ON hit.rid = win.rid AND hit.item_id = win.item_id
  AND hit.p >= win.s AND hit.p < win.s + win.k GROUP BY ALL),
sim AS (SELECT rid, item_id, m, s, sum(shared) AS shared, any_value(k) AS k, any_value(least(k, CASE WHEN n < {WIDTH} THEN 1 ELSE n - {WIDTH - 1} END)) AS wk FROM cnt GROUP BY ALL),
ok AS (SELECT d.doc_id, item_id, m, s, shared / (sim.k + wk - shared)::DOUBLE AS similarity FROM sim JOIN d USING (rid))
SELECT doc_id, item_id, round(similarity, 6) AS similarity, s::BIGINT AS start_word, m::BIGINT AS n_words
FROM ok WHERE similarity >= {SIMILARITY} - 1e-12
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, s) = 1
UNION ALL SELECT doc_id, item_id, 1.0, min(p)::BIGINT, m::BIGINT FROM runs WHERE w[(p + 1)::BIGINT:(p + m)::BIGINT] = iw GROUP BY doc_id, item_id, m"""
