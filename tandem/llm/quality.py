r"""Quality rules with risk-controlled thresholds (native: DataFrame functions only).

Features of a text are counted in its own row, so scoring shuffles nothing. Each rule turns them into a whole number, higher being worse, and has
a fixed list of cutoffs from lenient to strict. A plan is a set of rules, and its step t has the t-th cutoff of each; a document is rejected if any
rule of the plan fires. For each stratum the labelled documents that the base rules pass are the holdout: of n good ones, the step rejects k.
Steps are tested in their fixed order with the exact binomial tail P(Bin(n, alpha) <= k), the Clopper-Pearson test of "this verdict rejects more
than alpha of the good documents", at the level delta / (strata * plans), and a plan's first failure ends it. Fixed order needs no correction
within a plan, and Bonferroni's covers the choice among plans and strata, so with a confidence of 1 - delta no stratum's verdict, all its rules
together, rejects more than alpha of the good documents. Chosen is the certified step with the largest margin of bad over good documents rejected; on
ties the earliest step and the plan of fewest rules; without a certified step of positive margin a stratum has no rules.

Edge cases: a null or blank text has no words and fails the base rules, one of any length is counted whole; null strata form a stratum of their
own; labels that are null or of unknown documents don't count; a document counts once, however often it is labelled or repeated: it is good if all
its labels are, and its smallest row by (stratum, values) stands for it; without labels no stratum has rules; rows are judged one by one, so
repeated rows, null ids and further columns, whatever their names, pass through.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import n_words, table, without, words, SPACES

SYMBOLS = "#*$%&|<>"
WINDOW = 8
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Rule -> cutoffs on its value, from lenient to strict: a document is rejected above the cutoff.
GRID = {
    "symbols": [300, 200, 150, 100, 50, 20],
    "dup_lines": [160, 80, 40, 20, 10, 5],
    "repeats": [270, 250, 200, 150, 100, 50],
    "word_length": [150, 120, 100, 90, 80, 70],
}
STEPS = 6
#: Every set of rules, those of fewer rules first.
PLANS = [plan for size in range(1, len(GRID) + 1) for plan in combinations(GRID, size)]


def _value(rule: str) -> Column:
    part = {"symbols": (1000, "n_symbols", "word_chars"), "dup_lines": (1000, "n_dup_lines", "n_words"), "repeats": (1000, "n_repeat_words", "n_words"), "word_length": (10, "word_chars", "n_words")}[rule]
    return F.expr(f"({part[0]} * {part[1]}) div greatest({part[2]}, 1)")


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns of FEATURES (long); columns of docs by these names are replaced."""
    kept = [c for c in docs.columns if c not in FEATURES]
    own = [F.col(f"_c{i}") for i in range(len(kept))]
    docs = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(kept)])
    text = f"_c{kept.index(text)}"
    t = F.coalesce(F.col(text), F.lit(""))
    # Each step's arrays are used twice or more by the next, so the optimizer keeps the steps apart and nothing is computed in a loop.
    step = docs.select(*own, words(F.col(text)).alias("_w"))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    step = step.select(
        *own,
        F.size("_w").cast("long").alias("n_words"),
        F.length(without(t, SPACES)).cast("long").alias("word_chars"),
        (F.length(t) - F.length(without(t, SYMBOLS))).cast("long").alias("n_symbols"),
        lines.alias("_l"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    done = ["n_words", "word_chars", "n_symbols"]
    # Hashes of runs of 1, 2, 4 and 8 words, each of two of the step before; those beyond the last whole window are cut off at the end.
    for size in (1, 2, 4):
        after = F.slice("_h", size + 1, F.greatest(F.size("_h") - size, F.lit(0)))
        step = step.select(*own, *done, "_l", F.zip_with("_h", after, lambda a, b: F.xxhash64(a, b)).alias("_h"))
    step = step.select(*own, *done, "_l", F.slice("_h", 1, F.greatest(F.size("_h") - (WINDOW - 1), F.lit(0))).alias("_h"))
    step = step.select(
        *own, *done,
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_h") > F.size(F.array_distinct("_h")), F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("at"))))).otherwise(F.array().cast("array<struct<h:bigint,at:int>>")).alias("_p"),
    )
    done.append("n_dup_lines")
    same_as_next = F.zip_with("_p", F.slice("_p", 2, F.greatest(F.size("_p"), F.lit(1))), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
    step = step.select(*own, *done, "_p", same_as_next.alias("_e"))
    found = F.zip_with(F.zip_with("_p", "_e", lambda p, e: F.struct(p["at"].alias("at"), e.alias("e"))), F.concat(F.array(F.lit(False)), F.slice("_e", 1, F.greatest(F.size("_e") - 1, F.lit(0)))), lambda a, before: F.when(a["e"] | before, a["at"]))
    step = step.select(*own, *done, F.sort_array(F.array_compact(found)).alias("_s"))
    gaps = F.zip_with(F.slice("_s", 1, F.greatest(F.size("_s") - 1, F.lit(0))), F.slice("_s", 2, F.greatest(F.size("_s") - 1, F.lit(0))), lambda a, b: F.least(F.lit(WINDOW), b - a))
    covered = F.when(F.size("_s") > 0, F.aggregate(gaps, F.lit(WINDOW), lambda a, x: a + x)).otherwise(0)
    return step.select(*[c.alias(name) for c, name in zip(own, kept)], *done, covered.cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _log_factorial(x: Column) -> Column:
    """log(x!) to double precision: a table below 21, Stirling's series above."""
    y = F.greatest(x, F.lit(1)).cast("double")
    series = y * F.log(y) - y + 0.5 * F.log(2 * F.pi() * y) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5)))
    return F.when(x <= 20, F.log(F.factorial(F.least(x, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) by its terms from k downwards; those beyond twelve standard deviations are below double precision. 1 where k >= n * p."""
    steps = F.least(k, F.ceil(12 * F.sqrt(n * p) + 60)).cast("int")
    first = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    total = F.aggregate(
        F.when(steps > 0, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda acc, i: F.struct((acc["term"] * (k - i) * (1 - p) / ((n - k + i + 1) * p)).alias("term"), (acc["sum"] + acc["term"] * (k - i) * (1 - p) / ((n - k + i + 1) * p)).alias("sum")),
        lambda acc: acc["sum"],
    )
    return F.when(k < n * p, first * total).otherwise(1.0)


def thresholds(scored: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """One row per stratum with a certified verdict: _stratum and the cutoff of each rule (null: not in the plan). scored: features with doc_id and the stratum."""
    known = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg((F.min("quality") == 1).alias("_good"))
    held = scored.where(~base_failed()).select("doc_id", F.struct(_stratum(stratum).alias("_stratum"), *[_value(r).alias(r) for r in GRID]).alias("x"))
    held = held.groupBy("doc_id").agg(F.min("x").alias("x")).join(known, "doc_id").select("_good", "x.*")
    # The first step at which a rule fires, STEPS if at none: cutoffs fall from step to step, so it fires from there on.
    first = held.select("_stratum", "_good", *[F.coalesce(*[F.when(F.col(r) > cut, t) for t, cut in enumerate(cuts)], F.lit(STEPS)).alias(r) for r, cuts in GRID.items()])
    step = [F.least(*map(F.col, plan)) if len(plan) > 1 else F.col(plan[0]) for plan in PLANS]
    counts = first.groupBy("_stratum").agg(
        F.count_if("_good").alias("n"),
        F.count_if(~F.col("_good")).alias("m"),
        *[F.count_if(F.col("_good") & (x <= t)).alias(f"k_{p}_{t}") for p, x in enumerate(step) for t in range(STEPS)],
        *[F.count_if(~F.col("_good") & (x <= t)).alias(f"b_{p}_{t}") for p, x in enumerate(step) for t in range(STEPS)],
    )
    counts = table(counts, "quality-counts")  # a row per stratum
    cells = F.array(*[F.struct(F.lit(p).alias("plan"), F.lit(t).alias("step"), F.col(f"k_{p}_{t}").alias("k"), F.col(f"b_{p}_{t}").alias("b")) for p in range(len(PLANS)) for t in range(STEPS)])
    strata = counts.agg(F.count("*").alias("_tests"))
    long = counts.select("_stratum", "n", "m", F.inline(cells)).join(F.broadcast(strata))
    long = long.withColumn("_passed", binomial_tail(F.col("n"), F.col("k"), alpha) * F.col("_tests") * len(PLANS) <= delta)
    ends = long.groupBy("_stratum", "plan").agg(F.coalesce(F.min(F.when(~F.col("_passed"), F.col("step"))), F.lit(STEPS)).alias("end"))
    certified = long.join(ends, ["_stratum", "plan"]).where((F.col("step") < F.col("end")) & (F.col("b") * F.col("n") > F.col("k") * F.col("m")))
    best = certified.groupBy("_stratum").agg(F.max(F.struct((F.col("b") * F.col("n") - F.col("k") * F.col("m")).alias("margin"), (-F.col("step")).alias("step"), (-F.col("plan")).alias("plan"))).alias("best"))
    cutoff = lambda r: F.coalesce(*[F.when((F.col("best.plan") == -p) & (F.col("best.step") == -t), cut) for p, plan in enumerate(PLANS) if r in plan for t, cut in enumerate(GRID[r])])
    return table(best.select("_stratum", *[cutoff(r).alias(f"_cut_{r}") for r in GRID]), "quality-cutoffs")


def _stratum(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("\0null"))


def judge(scored: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """scored with base_failed and kept. cutoffs has a row per stratum; Spark broadcasts it if it is small and else splits a hot stratum."""
    own = [c for c in scored.columns if c not in ("base_failed", "kept")]
    rows = scored.select(*[F.col(f"`{c}`") for c in own], _stratum(stratum).alias("_stratum"))
    fires = [F.coalesce(_value(r) > F.col(f"_cut_{r}"), F.lit(False)) for r in GRID]
    fired = fires[0] | fires[1] | fires[2] | fires[3]
    return rows.join(cutoffs, "_stratum", "left").select(*[F.col(f"`{c}`") for c in own], base_failed().alias("base_failed"), (~base_failed() & ~fired).alias("kept"))


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """A row per document: doc_id, FEATURES, base_failed, kept. The texts are read once; thresholds come from the written features."""
    scored = table(features(docs.select("doc_id", "lang", "text")).drop("text"), "quality-features")
    return judge(scored, thresholds(scored, labels, alpha=alpha, delta=delta)).select("doc_id", *FEATURES, "base_failed", "kept")


def filter_documents(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The documents that the rules keep, with their own columns: rows are written with their features, so these are counted once, and no text is shuffled."""
    names = [f"_d{i}" for i in range(len(docs.columns))]
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)], "doc_id", "lang", "text")
    scored = table(features(plain).drop("text"), "quality-rows")
    cutoffs = thresholds(scored.select("doc_id", "lang", *FEATURES), labels, alpha=alpha, delta=delta)
    return judge(scored, cutoffs).where("kept").select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])


def _sql(alpha: float = 0.02, delta: float = 0.05) -> str:
    rules = {"symbols": "1000 * n_symbols // greatest(word_chars, 1)", "dup_lines": "1000 * n_dup_lines // greatest(n_words, 1)", "repeats": "1000 * n_repeat_words // greatest(n_words, 1)", "word_length": "10 * word_chars // greatest(n_words, 1)"}
    plans = ", ".join(f"({p}, {t}, {', '.join(str(cuts[t]) if r in plan else 'NULL' for r, cuts in GRID.items())})" for p, plan in enumerate(PLANS) for t in range(STEPS))
    fires = " OR ".join(f"coalesce({e} > cut_{r}, false)" for r, e in rules.items())
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '<null>') AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j)::BIGINT AS n FROM rep, range(8) r(j) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
f AS (SELECT d.doc_id, stratum, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN lines USING (doc_id) LEFT JOIN cov USING (doc_id)),
g AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM f),
plans(plan, step, {", ".join(f"cut_{r}" for r in GRID)}) AS (VALUES {plans}),
known AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
held AS (SELECT g.*, good FROM g JOIN known USING (doc_id) WHERE NOT base_failed),
cnt AS (SELECT stratum, plan, step, count(*) FILTER (good) AS n, count(*) FILTER (NOT good) AS m, count(*) FILTER (good AND ({fires})) AS k, count(*) FILTER (NOT good AND ({fires})) AS b FROM held, plans GROUP BY ALL),
tail AS (SELECT *, CASE WHEN k >= n * {alpha} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({alpha}) + (n - j) * ln(1 - {alpha})))) END AS p FROM cnt),
ends AS (SELECT stratum, plan, coalesce(min(step) FILTER (p * {len(PLANS)} * (SELECT count(DISTINCT stratum) FROM held) > {delta}), {STEPS}) AS last FROM tail GROUP BY ALL),
best AS (SELECT stratum, arg_max((plan, step), (b * n - k * m, -step, -plan)) AS x FROM tail JOIN ends USING (stratum, plan) WHERE step < last AND b * n > k * m GROUP BY ALL),
cuts AS (SELECT stratum, plans.* FROM best JOIN plans ON x = (plan, step))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND NOT ({fires})) AS kept FROM g LEFT JOIN cuts USING (stratum)
"""


SQL = _sql()
