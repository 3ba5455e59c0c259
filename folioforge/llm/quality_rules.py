"""Quality rules with risk-controlled cutoffs (DataFrame functions only).

Each rule rejects a document whose measure reaches a cutoff.  For every stratum
(language) and rule, cutoffs of a fixed grid are tested on the labelled good
documents, strictest evidence first: the cutoff that rejects least is tested
before the next, and testing stops at the first failure (fixed-sequence
testing, so no correction is due along the grid).  A test passes if, were the
true false-rejection rate ``alpha / rules``, so few rejections would have
exact binomial probability at most ``delta / (strata * rules)`` (Bonferroni
over strata and rules).  Hence with probability ``1 - delta`` no stratum loses
more than ``alpha`` of its good documents to all rules together.  Of the cutoffs
that passed, the one with the largest gain (labelled bad rejected, less
``weight`` times good rejected) is taken, ties going to the one that rejects
least; without gain the rule stays unused in that stratum.

Edge cases: null text has no words and fails the base rule; a null language is
a stratum of its own; repeated labels of one document count once (any bad label
makes it bad); of a labelled document with several rows, the largest measures of
each language count, once; a stratum with too few labels gets no cutoff; extra
columns are ignored; every row is judged.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import SPACE, materialize, table, words_of

#: The cutoffs of each rule's measure, from lenient to strict in what they keep.
GRID = [round(0.05 * k, 2) for k in range(1, 41)]
RULES = ("symbols", "repeats", "dup_lines", "capitals")
ALPHA, DELTA, WEIGHT = 0.04, 0.05, 5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def measures(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, lang, the counts of the contract, and each rule's measure."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", "lang", text.alias("text"))
    d = d.withColumns({"w": words_of(F.col("text")), "lines": F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)})
    d = d.withColumns({
        "n_words": F.size("w").cast("long"),
        "word_chars": F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long"),
        "n_symbols": (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long"),
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_capitals": (F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long"),
        # A 64-bit hash stands for each window; within one text two different windows share one by chance in about 1e-11 of texts.
        "h": F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<bigint>")),
    })
    d = d.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_capitals", "h")
    # Only texts with a repeated window are sorted with positions.
    d = d.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    same = lambda r, k: F.coalesce(r.x == F.get("s", k).x, F.lit(False))
    again = F.filter("s", lambda r, k: same(r, k - 1) | same(r, k + 1))
    d = d.withColumn("at", F.sort_array(F.transform(again, lambda r: r.i)))
    covered = F.aggregate("at", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, x: F.struct((a.n + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")), lambda a: a.n)
    d = d.withColumn("n_repeat_words", F.when(F.col("at").isNull(), 0).otherwise(covered).cast("long"))
    words = F.greatest("n_words", F.lit(1))
    return d.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
        (F.col("n_symbols") / words).alias("symbols"),
        (F.col("n_repeat_words") / words).alias("repeats"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_lines"),
        (F.col("n_capitals") / F.greatest("word_chars", F.lit(1))).alias("capitals"),
    )


def log_binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """ln P(X <= k) for X ~ Bin(n, p), exact but for rounding; terms are summed in logarithms."""
    odds = math.log(p / (1 - p))
    first = n * F.lit(math.log1p(-p))
    return F.aggregate(
        F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
        F.struct(first.alias("t"), first.alias("s")),
        lambda a, i: F.struct(
            (a.t + F.log((n - i + 1) / i) + odds).alias("t"),
            (a.s + F.log1p(F.exp(a.t + F.log((n - i + 1) / i) + odds - a.s))).alias("s"),
        ),
        lambda a: a.s,
    )


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, weight: float = WEIGHT) -> DataFrame:
    """(lang, rule, cutoff) of every certified cutoff that has a gain."""
    lab = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    grid = F.array(*[F.lit(float(c)) for c in GRID])
    level_of = lambda rule: F.size(F.filter(grid, lambda c: c <= F.col(rule)))
    # One row a document and stratum: a binomial trial is a document, however often it occurs.
    once = measured.where(~F.col("base_failed")).join(lab, "doc_id").groupBy("doc_id", "lang").agg(F.max("good").alias("good"), *[F.max(r).alias(r) for r in RULES])
    rows = once.select(
        "lang", "good", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), level_of(r).alias("level")) for r in RULES])).alias("x")
    )
    counts = rows.groupBy("lang", "x.rule", "x.level").agg(F.sum(F.col("good").cast("long")).alias("g"), F.sum((~F.col("good")).cast("long")).alias("b"))
    per = counts.groupBy("lang", "rule").agg(F.collect_list(F.struct("level", "g", "b")).alias("c"), F.sum("g").alias("n"))
    per = per.withColumn("tests", F.count("*").over(Window.partitionBy("rule")) * len(RULES))
    above = lambda of: lambda level: F.aggregate(F.filter("c", lambda y: y.level >= level), F.lit(0).cast("long"), lambda a, y: a + y[of])
    per = per.withColumn("steps", F.transform(F.sequence(F.lit(1), F.lit(len(GRID))), lambda lv: F.struct(lv.alias("level"), above("g")(lv).alias("k"), above("b")(lv).alias("bad"))))
    rate = alpha / len(RULES)
    step = per.select("lang", "rule", "n", "tests", F.explode("steps").alias("s")).select("lang", "rule", "n", "tests", "s.*")
    passed = (F.col("k") <= F.col("n") * rate) & (log_binomial_cdf(F.least("k", F.ceil(F.col("n") * rate)), F.col("n"), rate) <= F.log(F.lit(delta) / F.col("tests")))
    step = step.withColumn("passed", F.coalesce(passed, F.lit(False)))
    # Grid levels of one stratum and rule: a window over at most len(GRID) rows.
    step = step.withColumn("all_above", F.min("passed").over(Window.partitionBy("lang", "rule").orderBy(F.desc("level"))))
    gain = F.col("bad") - weight * F.col("k")
    best = step.where("all_above").where(gain > 0).groupBy("lang", "rule").agg(F.max_by("level", F.struct(gain.alias("gain"), F.col("level"))).alias("level"))
    return best.select("lang", "rule", F.get(grid, F.col("level") - 1).alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, weight: float = WEIGHT) -> DataFrame:
    """Measures, base_failed, rejected_by (comma-joined rules) and kept of every row."""
    measured = materialize(measures(docs), "quality")
    chosen = cutoffs(measured, labels, alpha, delta, weight)
    by_lang = chosen.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cut")).select(F.col("lang").alias("stratum"), "cut")
    found = measured.join(by_lang, measured.lang.eqNullSafe(by_lang.stratum), "left")
    rejects = F.array_compact(F.array(*[F.when(F.col(r) >= F.col("cut")[r], F.lit(r)) for r in RULES]))
    found = found.withColumn("rejects", rejects)
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("rejects") == 0)).alias("kept"), F.array_join("rejects", ",").alias("rejected_by"),
    )


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Contract of query 1."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def oracle() -> str:
    """DuckDB SQL of query 1."""
    grid = "[" + ", ".join(f"{c}::DOUBLE" for c in GRID) + "]"
    rate = ALPHA / len(RULES)
    space = SPACE.replace("'", "''")
    rows = " UNION ALL ".join(f"SELECT rid, lang, '{r}' AS rule, {r} AS v FROM m" for r in RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '{space}'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '{space}', '', 'g')) > 0) AS lines FROM d),
win AS (SELECT rid, unnest(range(1, len(w) - 1)) AS p, w FROM w WHERE len(w) >= 3),
win2 AS (SELECT rid, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS t FROM win),
rep AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, t) AS c FROM win2) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM rep) GROUP BY rid),
m0 AS (SELECT w.rid, doc_id, lang, len(w)::BIGINT AS n_words, length(regexp_replace(text, '{space}', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(lines) AS n_lines,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
  length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_capitals FROM w LEFT JOIN cov USING (rid)),
m AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  n_symbols / greatest(n_words, 1)::DOUBLE AS symbols, n_repeat_words / greatest(n_words, 1)::DOUBLE AS repeats,
  n_dup_lines / greatest(n_lines, 1)::DOUBLE AS dup_lines, n_capitals / greatest(word_chars, 1)::DOUBLE AS capitals FROM m0),
lab AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
v AS ({rows}),
lv AS (SELECT v.lang, v.rule, max(v.v) AS v, any_value(lab.good) AS good FROM v JOIN m USING (rid) JOIN lab ON lab.doc_id = m.doc_id WHERE NOT m.base_failed GROUP BY v.lang, v.rule, m.doc_id),
g AS (SELECT unnest({grid}) AS cutoff),
s AS (SELECT lang, rule, cutoff, count(*) FILTER (good AND v >= cutoff) AS k, count(*) FILTER (NOT good AND v >= cutoff) AS bad, count(*) FILTER (good) AS n
  FROM lv, g GROUP BY ALL),
t AS (SELECT *, (SELECT count(DISTINCT coalesce(lang, '')) FROM lv) * {len(RULES)} AS tests FROM s),
p AS (SELECT *, k <= n * {rate} AND n > 0 AND list_sum(list_transform(range(0, (k + 1)::BIGINT),
  lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({rate}) + (n - i) * ln(1 - {rate})))) <= {DELTA} / tests AS passed FROM t),
a AS (SELECT *, min(passed::INT) OVER (PARTITION BY lang, rule ORDER BY cutoff DESC) AS ok, bad - {WEIGHT} * k AS gain FROM p),
b AS (SELECT lang, rule, cutoff FROM a WHERE ok = 1 AND gain > 0 QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY gain DESC, cutoff DESC) = 1),
r AS (SELECT v.rid, string_agg(v.rule, ',' ORDER BY list_position({list(RULES)}, v.rule)) AS rejected_by
  FROM v JOIN b ON b.lang IS NOT DISTINCT FROM v.lang AND b.rule = v.rule AND v.v >= b.cutoff GROUP BY v.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND r.rejected_by IS NULL AS kept, coalesce(r.rejected_by, '') AS rejected_by
FROM m LEFT JOIN r USING (rid)"""
