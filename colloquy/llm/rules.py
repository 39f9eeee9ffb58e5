"""Quality rules with thresholds that adapt to each language and source.

Metrics of every document are computed inside its row by built-in functions. For each language and source a
KLL sketch of every metric is built from partial sketches; sketches of a small group are merged into that of its
language, and of a small language into that of all rows. A document is kept if no metric lies further beyond its
group's quartiles than so many times their distance (``RULES``). Where the quartiles coincide, as for symbols in prose, a
tiny least distance stands in, so that one stray sign is no outlier; everywhere else the sketches decide. Only
documents that pass the base rules enter the sketches.

Sketches are exact up to ``SKETCH_K`` rows of a group and random beyond, with a rank error of about 0.1 % at that size.

Defined results: null and empty texts have no words and fail the base rules; null languages and sources form
groups of their own; a group without a passing document falls back like a small one; repeated rows count each; a
metric that ties with its threshold is within it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import common

SPACE = "[\\x20\\x09-\\x0D]"
WIDTH, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Items of a sketch, and rows that a group needs for thresholds of its own.
SKETCH_K, GROUP_ROWS = 4096, 50
#: Metric to the least distance of its quartiles that counts.
SPREAD = {"symbol_rate": 0.004, "upper_rate": 0.004, "word_length": 0.05, "distinct_rate": 0.03, "next_rate": 0.004, "gap_rate": 0.004}
#: (metric, side, distances of the quartiles beyond the quartile of that side): rates of symbols, capitals and of words
#: that equal the one before or two before only go wrong upwards, that of distinct words downwards, the length of words both ways.
RULES = (("symbol_rate", 1, 8.0), ("upper_rate", 1, 8.0), ("word_length", 1, 8.0), ("word_length", -1, 4.0), ("distinct_rate", -1, 4.0), ("next_rate", 1, 8.0), ("gap_rate", 1, 8.0))
#: Groups whose thresholds are sent to all tasks; with more of them the join is left to the planner.
BROADCAST_GROUPS = 100_000


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _pairs(x: Column, lag: int, use) -> Column:
    """``use`` of every item and the one ``lag`` places on."""
    return _let(x, lambda v: F.zip_with(F.slice(v, 1, F.size(v) - lag), F.slice(v, 1 + lag, F.size(v) - lag), use))


def _repeated(hashes: Column) -> Column:
    """Words in windows of ``WIDTH`` words that occur twice or more: windows are hashed by halves, sorted with their places, and neighbours compared."""

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda a, b: F.struct((a["h"] == b["h"]).alias("same"), a["i"].alias("a"), b["i"].alias("b"))
            pairs = F.filter(_pairs(s, 1, same), lambda p: p["same"])
            return F.sort_array(F.array_distinct(F.flatten(F.transform(pairs, lambda p: F.array(p["a"], p["b"])))))

        def spread(p: Column) -> Column:
            return F.aggregate(_pairs(p, 1, lambda a, b: F.least(b - a, F.lit(WIDTH))), F.lit(WIDTH), lambda n, g: n + g)

        return _let(_let(ordered, places), spread)

    windows = hashes
    for lag in (1, 2, 4):
        windows = _pairs(windows, lag, lambda a, b: F.xxhash64(a, b))
    found = _let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(hashes) <= WIDTH, F.lit(0)).otherwise(found).cast("long")


def _equal(hashes: Column, lag: int) -> Column:
    return F.when(F.size(hashes) <= lag, F.lit(0)).otherwise(F.size(F.filter(_pairs(hashes, lag, lambda a, b: a == b), lambda same: same)))


def metrics(text: Column) -> dict[str, Column]:
    """The base counts and the counts behind the rates of a whole text, from built-in functions alone. Words are hashed once."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    chars = F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long")
    without = lambda marks: F.length(text) - F.length(F.translate(text, marks, ""))
    counted = _let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.struct(
            F.size(h).cast("long").alias("n_words"), _repeated(h).alias("n_repeat_words"), F.size(F.array_distinct(h)).alias("n_distinct"), _equal(h, 1).alias("n_next"), _equal(h, 2).alias("n_gap")
        ),
    )
    lined = _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    return {"counted": counted, "n_dup_lines": lined, "word_chars": chars, "n_symbols": without("#*$%&|<>").cast("long"), "n_upper": without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long")}


def measured(documents: DataFrame) -> DataFrame:
    """``documents`` with a struct column of metrics, rates and the base verdict, named ``_rules``."""
    # Two steps: what the first computes is only referred to by the second.
    got = documents.withColumn("_rules", F.struct(*[v.alias(k) for k, v in metrics(F.col("text")).items()]))
    c = F.col("_rules")
    n, chars = c["counted"]["n_words"], F.greatest(c["word_chars"], F.lit(1))
    per_word = F.greatest(n, F.lit(1))
    failed = (n < LEAST_WORDS) | (100 * c["counted"]["n_repeat_words"] > MOST_REPEATED * n)
    return got.withColumn(
        "_rules",
        F.struct(
            n.alias("n_words"), c["word_chars"].alias("word_chars"), c["n_symbols"].alias("n_symbols"), c["n_dup_lines"].alias("n_dup_lines"),
            c["counted"]["n_repeat_words"].alias("n_repeat_words"), failed.alias("base_failed"),
            (c["n_symbols"] / per_word).alias("symbol_rate"), (c["n_upper"] / chars).alias("upper_rate"), (chars / per_word).alias("word_length"),
            (c["counted"]["n_distinct"] / per_word).alias("distinct_rate"), (c["counted"]["n_next"] / per_word).alias("next_rate"), (c["counted"]["n_gap"] / per_word).alias("gap_rate"),
        ),
    )


def thresholds(rated: DataFrame, k: int = SKETCH_K, group_rows: int = GROUP_ROWS) -> DataFrame:
    """lang, source and the threshold of every rule (``l0``, ``l1`` ...), from (lang, source, _rules) of all documents."""
    passing = ~F.col("_rules.base_failed")
    groups = rated.groupBy("lang", "source").agg(
        F.count(F.when(passing, 1)).alias("n"), *[F.expr(f"kll_sketch_agg_double(CASE WHEN NOT _rules.base_failed THEN _rules.{m} END, {k})").alias(m) for m in SPREAD]
    )
    groups = common.staged(groups, "sketches")
    merged = [F.expr(f"kll_merge_agg_double({m})").alias(f"_{m}") for m in SPREAD]
    langs = groups.groupBy(F.col("lang").alias("_lang")).agg(F.sum("n").alias("_n"), *merged)
    # One row of sketches, whose size the sketches bound.
    everything = groups.agg(F.sum("n").alias("_n"), *merged).first()
    both = groups.join(langs, groups["lang"].eqNullSafe(langs["_lang"]))

    def limit(k: int) -> Column:
        m, side, reach = RULES[k]
        if not everything["_n"]:
            return F.lit(None).cast("double").alias(f"l{k}")
        sketch = F.when(F.col("n") >= group_rows, F.col(m)).when(F.col("_n") >= group_rows, F.col(f"_{m}")).otherwise(F.lit(bytes(everything[f"_{m}"])))
        quartile = lambda q: F.kll_sketch_get_quantile_double(sketch, F.lit(q))
        from_ = quartile(0.75 if side > 0 else 0.25)
        return (from_ + side * reach * F.greatest(quartile(0.75) - quartile(0.25), F.lit(SPREAD[m]))).alias(f"l{k}")

    return common.staged(both.select("lang", "source", *map(limit, range(len(RULES)))), "thresholds")


def judged(documents: DataFrame, limits: DataFrame) -> DataFrame:
    """``documents`` (with _rules) joined with their group's thresholds; ``_kept`` is the verdict."""
    named = limits.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), F.struct(*[f"l{k}" for k in range(len(RULES))]).alias("_limits"))
    if named.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        named = F.broadcast(named)
    same = documents["lang"].eqNullSafe(named["_l"]) & documents["source"].eqNullSafe(named["_s"])
    held = lambda m, side, limit: F.col(f"_rules.{m}") <= limit if side > 0 else F.col(f"_rules.{m}") >= limit
    within = [F.coalesce(held(m, side, F.col(f"_limits.l{k}")), F.lit(True)) for k, (m, side, _) in enumerate(RULES)]
    verdict = ~F.col("_rules.base_failed")
    for w in within:
        verdict &= w
    return documents.join(named, same, "left").withColumn("_kept", verdict).drop("_l", "_s", "_limits")


def apply_rules(documents: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every document."""
    rated = common.staged(measured(documents.select("doc_id", "lang", "source", "text")).drop("text"), "rated")
    return judged(rated, thresholds(rated)).select("doc_id", "_rules.*", F.col("_kept").alias("kept"))


def keep_good(documents: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    rated = measured(documents.select(F.struct("*").alias("_row"), "lang", "source", "text")).drop("text")
    rated = common.staged(rated, "rated")  # the metrics cost more than writing the rows once
    return judged(rated, thresholds(rated.select("lang", "source", "_rules"))).where("_kept").select("_row.*")


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_rules(common.read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    """The contract of op6 for DuckDB. Its quantiles are exact, as sketches are of up to ``SKETCH_K`` documents."""
    quartiles = ", ".join(f"quantile_disc({m}, 0.25) AS {m}_1, quantile_disc({m}, 0.75) AS {m}_3" for m in SPREAD)
    chosen = lambda m, k: f"CASE WHEN g.n >= {GROUP_ROWS} THEN g.{m}_{k} WHEN l.n >= {GROUP_ROWS} THEN l.{m}_{k} ELSE a.{m}_{k} END"
    iqr = lambda m: f"greatest({chosen(m, 3)} - {chosen(m, 1)}, {SPREAD[m]})"
    held = lambda m, side, reach: f"{m} <= {chosen(m, 3)} + {reach} * {iqr(m)}" if side > 0 else f"{m} >= {chosen(m, 1)} - {reach} * {iqr(m)}"
    within = " AND ".join(f"coalesce({held(*rule)}, true)" for rule in RULES)
    return rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS s FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 7)) AS i FROM w WHERE len(words) >= 8)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM again) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
b AS (SELECT w.doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_upper, len(list_distinct(words)) AS n_distinct,
  CASE WHEN len(words) < 2 THEN 0 ELSE len(list_filter(list_zip(words[1:len(words) - 1], words[2:]), lambda p: p[1] = p[2])) END AS n_next,
  CASE WHEN len(words) < 3 THEN 0 ELSE len(list_filter(list_zip(words[1:len(words) - 2], words[3:]), lambda p: p[1] = p[2])) END AS n_gap,
  coalesce(ln.dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)),
m AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, n_symbols / greatest(n_words, 1) AS symbol_rate,
  n_upper / greatest(word_chars, 1) AS upper_rate, greatest(word_chars, 1) / greatest(n_words, 1) AS word_length, n_distinct / greatest(n_words, 1) AS distinct_rate,
  n_next / greatest(n_words, 1) AS next_rate, n_gap / greatest(n_words, 1) AS gap_rate FROM b),
ok AS (SELECT * FROM m WHERE NOT base_failed),
g AS (SELECT lang, source, count(*) AS n, {quartiles} FROM ok GROUP BY lang, source), l AS (SELECT lang, count(*) AS n, {quartiles} FROM ok GROUP BY lang), a AS (SELECT {quartiles} FROM ok)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {within} AS kept
FROM m LEFT JOIN g ON m.lang IS NOT DISTINCT FROM g.lang AND m.source IS NOT DISTINCT FROM g.source LEFT JOIN l ON m.lang IS NOT DISTINCT FROM l.lang CROSS JOIN a
"""


SQL = _sql()
