"""Scores of ordinal labels in long form (case_id, profile, dim, gold, pred), and of annotated propositions."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.ship import ship

#: The bootstrap's repeats and seed, and its order statistics.
REPEATS, SEED, TAILS = 2000, 20261017, (0.025, 0.975)


def planned(plan: DataFrame, predicted: DataFrame) -> DataFrame:
    """Every planned (case, dim) with its prediction, null where there is none: denominators stay."""
    return plan.join(predicted, ["case_id", "dim"], "left")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def measures() -> dict[str, Column]:
    """A gold level that is met is a hit; another level costs a false positive and a miss; none costs a miss."""
    g, p = F.col("gold"), F.col("pred")
    tp = F.count_if(g == p)
    fp = F.count_if(p.isNotNull() & (g.isNull() | (g != p)))
    fn = F.count_if(g.isNotNull() & (p.isNull() | (g != p)))
    known, answered = F.count("gold"), F.count_if(g.isNotNull() & p.isNotNull())
    wrong = F.count_if(g != p)
    silent = F.count_if(g.isNotNull() & p.isNull())
    penalty = F.sum(F.when(g.isNotNull(), F.coalesce(F.abs(g - p) / 2.0, F.lit(1.0))))
    f1 = ratio(2 * tp, 2 * tp + fp + fn)
    mae = ratio(penalty, known)
    return {
        "tp": tp, "fp": fp, "fn": fn, "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "micro_f1": f1, "coverage": ratio(answered, known), "mismatch": ratio(wrong, answered),
        "unanswerable_assertion": ratio(F.count_if(g.isNull() & p.isNotNull()), F.count_if(g.isNull())), "jaccard": ratio(tp, tp + fp + fn), "hamming": ratio(2 * wrong + silent, known * 3),
        "mae_covered": F.avg(F.abs(g - p) / 2.0), "mae_penalised": mae, "coupling": (f1 + 1 - mae) / 2,
    }


def scores(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(*[c.alias(n) for n, c in measures().items()])


def macro(rows: DataFrame, by: str, name: str) -> DataFrame:
    """The mean over groups of their F1, where it is defined."""
    return scores(rows, by).agg(F.avg("micro_f1").alias(name))


def kappa(rows: DataFrame, *by: str, weighted: bool = True, levels: int = 3) -> DataFrame:
    """Cohen's kappa, quadratic weights or none, over rows with both levels; null where it is undefined."""
    both = rows.where("gold is not null and pred is not null")
    d = (F.col("gold") - F.col("pred")) * (F.col("gold") - F.col("pred")) if weighted else (F.col("gold") != F.col("pred")).cast("int")
    cells = [F.count_if(F.col(c) == v).alias(f"{c}{v}") for c in ("gold", "pred") for v in range(levels)]
    t = both.groupBy(*by).agg(F.count("*").alias("n"), F.sum(d).alias("seen"), *cells)
    chance = sum((F.col(f"gold{i}") * F.col(f"pred{j}") * ((i - j) ** 2 if weighted else int(i != j)) for i in range(levels) for j in range(levels)), F.lit(0))
    return t.select(*by, "n", F.when(chance != 0, 1 - F.col("seen") * F.col("n") / chance).alias("kappa"))


def icc(rows: DataFrame, *by: str) -> DataFrame:
    """ICC(2,1) of two raters from sums alone."""
    both = rows.where("gold is not null and pred is not null")
    t = both.groupBy(*by).agg(F.count("*").alias("n"), F.sum("gold").alias("a"), F.sum("pred").alias("b"), F.sum(F.col("gold") * F.col("gold") + F.col("pred") * F.col("pred")).alias("q"), F.sum((F.col("gold") + F.col("pred")) * (F.col("gold") + F.col("pred"))).alias("s"))
    n = F.col("n").cast("double")
    mean2 = (F.col("a") + F.col("b")) * (F.col("a") + F.col("b")) / (2 * n)
    ss_rows, ss_cols, ss_all = F.col("s") / 2 - mean2, (F.col("a") * F.col("a") + F.col("b") * F.col("b")) / n - mean2, F.col("q") - mean2
    msr, msc, mse = ss_rows / (n - 1), ss_cols, (ss_all - ss_rows - ss_cols) / (n - 1)
    down = msr + mse + 2 * (msc - mse) / n
    return t.select(*by, "n", F.when((n > 1) & (down != 0), (msr - mse) / down).alias("icc"))


def resample_weights(spark: SparkSession, profiles: list, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """``rep, profile, weight``: how often each profile is drawn; the same draws serve every method that is compared."""
    rng, rows = random.Random(seed), []
    for r in range(repeats):
        drawn = {}
        for p in rng.choices(profiles, k=len(profiles)):
            drawn[p] = drawn.get(p, 0) + 1
        rows += [(r, p, n) for p, n in drawn.items()]
    return spark.createDataFrame(rows, "rep int, profile string, weight int") if rows else spark.createDataFrame([], "rep int, profile string, weight int")


def drawn_weights(profiles: DataFrame, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """What :func:`resample_weights` gives for the sorted distinct values of ``profiles (profile)``, made in Spark.

    A task draws its own repeats: numpy's Mersenne Twister gives the numbers of random.Random, and earlier ones are skipped.
    """
    spark = profiles.sparkSession
    ship(spark)
    names = profiles.where("profile is not null").distinct().orderBy("profile")
    numbered = spark.createDataFrame(names.rdd.map(lambda r: r[0]).zipWithIndex(), "profile string, k long")
    n = names.count()

    def run(batches):
        _, state, _ = random.Random(seed).getstate()
        rng, at = np.random.RandomState(), 0
        rng.set_state(("MT19937", np.array(state[:-1], np.uint32), state[-1]))
        for b in batches:
            for r in b.column("id").to_pylist():
                while at < r * n:
                    at += len(rng.random_sample(min(1 << 20, r * n - at)))
                k, weight = np.unique((rng.random_sample(n) * n).astype(np.int64), return_counts=True)
                at += n
                for i in range(0, n, 1 << 16):
                    part = slice(i, i + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k[part]), r, np.int32)), pa.array(k[part]), pa.array(weight[part].astype(np.int32))], ["rep", "k", "weight"])

    return spark.range(repeats).mapInArrow(run, "rep int, k long, weight int").join(numbered, "k").select("rep", "profile", "weight")


def poisson_limits(most: int = 12) -> list[int]:
    """How far a 32-bit number must reach for 1, 2, ... draws of a Poisson law of mean 1."""
    term, total, out = math.exp(-1), 0.0, []
    for k in range(1, most + 1):
        total += term
        out.append(math.floor(total * 2**32))
        term /= k
    return out


def hashed_weights(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """``rows`` (profile, rep) with ``weight``, how often the profile is drawn in the repeat: a Poisson number read from the MD5
    of ``profile:rep:seed``.

    Draws of one profile don't depend on the others, so no table of draws is made, and every method that is compared meets
    the same ones.
    """
    u = F.conv(F.substring(F.md5(F.concat(F.col("profile").cast("string"), F.lit(":"), F.col("rep").cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long")
    return rows.withColumn("_u", u).withColumn("weight", sum((F.when(F.col("_u") >= limit, 1).otherwise(0) for limit in poisson_limits()), F.lit(0))).drop("_u")


def _repeated(each: DataFrame, names: list[str], weights: DataFrame | None, repeats: int = REPEATS) -> DataFrame:
    """``rep`` and the weighted sums of ``names`` over a row per profile: with drawn weights, or else hashed ones in one pass."""
    if weights is not None:
        both = each.join(weights, "profile")
    else:
        both = hashed_weights(each.where("profile is not null").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))).where("weight > 0")
    return both.groupBy("rep").agg(*[F.sum(F.col(n) * F.col("weight")).cast("double").alias(n) for n in names])


def _ends(values: DataFrame, *by: str) -> DataFrame:
    """``low, high`` of ``x``, order statistics over the repeats (REPEATS rows each) in which it is defined."""
    w = Window.partitionBy(*by)
    ranked = values.where("x is not null").withColumn("r", F.row_number().over(w.orderBy("x")) - 1).withColumn("n", F.count("*").over(w))
    return ranked.groupBy(*by).agg(*[F.max(F.when(F.col("r") == F.floor(q * (F.col("n") - 1)), F.col("x"))).alias(name) for q, name in zip(TAILS, ("low", "high"), strict=True)])


def paired_bootstrap(a: DataFrame, b: DataFrame, weights: DataFrame | None = None, repeats: int = REPEATS) -> DataFrame:
    """``low, high`` of the micro F1 of method a less that of b over the same draws of profiles; a profile that only one of
    them has counts as empty for the other."""
    of = lambda rows, k: scores(rows, "profile").select("profile", *[F.col(c).alias(f"{c}_{k}") for c in ("tp", "fp", "fn")])
    names = [f"{c}_{k}" for k in "ab" for c in ("tp", "fp", "fn")]
    each = of(a, "a").join(of(b, "b"), "profile", "full").fillna(0, names)
    f1 = lambda k: ratio(2 * F.col(f"tp_{k}"), 2 * F.col(f"tp_{k}") + F.col(f"fp_{k}") + F.col(f"fn_{k}"))
    return _ends(_repeated(each, names, weights, repeats).select((f1("a") - f1("b")).alias("x")))


def bootstrap_f1(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """Clustered interval of the micro F1: profiles are drawn whole, and order statistics give the ends."""
    s = scores(rows, "profile").select("profile", "tp", "fp", "fn")
    each = s.join(weights, "profile").groupBy("rep").agg(*[F.sum(F.col(c) * F.col("weight")).alias(c) for c in ("tp", "fp", "fn")])
    f = each.select("rep", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1")).where("f1 is not null")
    rank = F.row_number().over(Window.orderBy("f1")) - 1  # REPEATS rows
    n = F.count("*").over(Window.partitionBy())
    pick = f.withColumn("r", rank).withColumn("n", n)
    return pick.agg(*[F.max(F.when(F.col("r") == F.floor(q * (F.col("n") - 1)), F.col("f1"))).alias(name) for q, name in zip(TAILS, ("low", "high"), strict=True)])


def paired_difference(a: DataFrame, b: DataFrame, weights: DataFrame) -> DataFrame:
    """Per repeat, the F1 of method a less that of b, on the same draws."""
    def of(rows, name):
        s = scores(rows, "profile").join(weights, "profile").groupBy("rep").agg(*[F.sum(F.col(c) * F.col("weight")).alias(c) for c in ("tp", "fp", "fn")])
        return s.select("rep", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias(name))

    return of(a, "fa").join(of(b, "fb"), "rep").select("rep", (F.col("fa") - F.col("fb")).alias("difference"))


def annotations(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """A case passes if proposition, assessment and roles are equal and all required positions were available."""
    p = predictions.select("case_id", F.col("proposition").alias("_p"), F.col("assessment").alias("_a"), F.col("roles").alias("_r"), F.col("available_positions").alias("_v"))
    both = cases.join(p, "case_id", "left")
    same = lambda m: F.sort_array(F.map_entries(m))
    ok = (F.col("proposition") == F.col("_p")) & (F.col("assessment") == F.col("_a")) & (same("roles") == same("_r")) & (F.size(F.array_except("required_positions", "_v")) == 0)
    return both.select("case_id", F.coalesce(ok, F.lit(False)).alias("passed"), F.col("_p").isNull().alias("missing"))


def macros(rows: DataFrame) -> DataFrame:
    """``sample_macro_f1, label_macro_f1, jaccard``: means over cases, and over (dim, level), where something was to be met."""
    g, p = F.col("gold"), F.col("pred")
    tp, fp, fn = F.count_if(g == p), F.count_if(g != p), F.count_if(g.isNotNull() & (p.isNull() | (g != p)))
    case = rows.groupBy("case_id").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn")).where("tp + fp + fn > 0")
    f1 = 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))
    by_case = case.agg(F.avg(f1).alias("sample_macro_f1"), F.avg(F.col("tp") / (F.col("tp") + F.col("fp") + F.col("fn"))).alias("jaccard"))
    known = rows.where("gold is not null")
    met = known.select("dim", g.alias("level"), (F.coalesce(g == p, F.lit(False))).alias("hit"), F.lit(False).alias("false_"))
    told = known.where("pred <> gold").select("dim", p.alias("level"), F.lit(None).cast("boolean").alias("hit"), F.lit(True).alias("false_"))
    label = met.union(told).groupBy("dim", "level").agg(F.count_if(F.col("hit")).alias("tp"), F.count_if("false_").alias("fp"), F.count_if(~F.col("hit")).alias("fn"))
    return by_case.crossJoin(label.agg(F.avg(f1).alias("label_macro_f1"))).select("sample_macro_f1", "label_macro_f1", "jaccard")  # one row each


def extraction_violations(rows: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """Labels (case_id, dim, value, confidence, quote, source) that break a rule of extraction, with the rule.

    A value is a level or null, a confidence lies in 0 to 1, and a level's quote stands in the source.
    """
    bad_quote = F.col("value").isNotNull() & F.coalesce((tx.stripped(F.col("quote")) == "") | ~F.contains("source", "quote"), F.lit(True))
    rules = [
        F.when(F.col("value").isNotNull() & ~F.col("value").isin(0, 1, 2), "value"), F.when(F.coalesce(~F.col("confidence").between(0, 1), F.lit(True)), "confidence"),
        F.when(bad_quote, "quote"), F.when(F.coalesce(~F.col("dim").isin(*dims), F.lit(True)), "dimension"),
    ]
    return rows.select("case_id", "dim", F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("violation"))


def permuted(rows: DataFrame) -> DataFrame:
    """A baseline that keeps scenes and shifts persons: each profile gets the predictions of the next one in order, and the
    last those of the first, for the same (variant, dim); nobody keeps their own unless there is one profile."""
    order = Window.orderBy("profile")  # a row per profile
    names = rows.select("profile").distinct().withColumn("k", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy()))
    other = names.select(F.col("profile").alias("_next"), "k")
    pairs = names.select("profile", (F.col("k") % F.col("n") + 1).alias("k")).join(other, "k").drop("k")
    given = rows.select(F.col("profile").alias("_next"), "variant", "dim", F.col("pred").alias("_pred"))
    return rows.drop("pred").join(pairs, "profile").join(given, ["_next", "variant", "dim"], "left").drop("_next").withColumnRenamed("_pred", "pred")


def uniform(rows: DataFrame, trial: int = 0, levels: int = 3) -> DataFrame:
    """A baseline of levels drawn evenly, the same ones for the same trial."""
    return rows.withColumn("pred", F.pmod(F.xxhash64("case_id", "dim", F.lit(trial)), F.lit(levels)).cast("int"))


#: What a bootstrap gives intervals of.
INTERVALS = ("micro_f1", "coverage", "mae_penalised", "coupling", "weighted_kappa", "icc")


def bootstrap(rows: DataFrame, weights: DataFrame | None = None, repeats: int = REPEATS) -> DataFrame:
    """``metric, low, high`` of all INTERVALS: profiles are drawn whole with ``weights (rep, profile, weight)``, or by hash.

    Every metric is a function of counts that add up over profiles, so a repeat is a weighted sum of a row per profile. A
    metric takes the repeats in which it is defined, and order statistics give its ends.
    """
    g, p = F.col("gold"), F.col("pred")
    cells = {f"c{i}{j}": F.count_if((g == i) & (p == j)) for i in range(3) for j in range(3)}
    base = {"known": F.count("gold"), "silent": F.count_if(g.isNotNull() & p.isNull())}
    each = rows.groupBy("profile").agg(*[c.alias(n) for n, c in {**base, **cells}.items()])
    names = [*base, *cells]
    s = _repeated(each, names, weights, repeats)
    pairs = [(i, j) for i in range(3) for j in range(3)]

    def total(f) -> Column:
        """The sum of f(gold, pred) over the cells."""
        return sum((F.col(f"c{i}{j}") * float(f(i, j)) for i, j in pairs if f(i, j)), F.lit(0.0))

    of = lambda k, i: sum((F.col(f"c{i}{j}" if k else f"c{j}{i}") for j in range(3)), F.lit(0.0))
    chance = sum((of(1, i) * of(0, j) * float((i - j) ** 2) for i, j in pairs if i != j), F.lit(0.0))
    c = F.col
    # Step by step, so that no expression repeats what another one has computed.
    steps = [
        {"n": total(lambda i, j: 1), "tp": total(lambda i, j: i == j), "off": total(lambda i, j: abs(i - j) / 2), "seen": total(lambda i, j: (i - j) ** 2), "chance": chance,
         "a": total(lambda i, j: i), "b": total(lambda i, j: j), "squares": total(lambda i, j: i * i + j * j), "sums": total(lambda i, j: (i + j) ** 2)},
        {"mean": ratio((c("a") + c("b")) * (c("a") + c("b")), 2 * c("n")), "f1": ratio(2 * c("tp"), 2 * c("n") + c("silent")), "mae": ratio(c("off") + c("silent"), c("known"))},
        {"msr": ratio(c("sums") / 2 - c("mean"), c("n") - 1), "msc": ratio(c("a") * c("a") + c("b") * c("b"), c("n")) - c("mean")},
        {"mse": ratio(c("squares") - c("mean") - (c("sums") / 2 - c("mean")) - c("msc"), c("n") - 1)},
        {"down": c("msr") + c("mse") + ratio(2 * (c("msc") - c("mse")), c("n"))},
    ]
    for columns in steps:
        s = s.withColumns(columns)
    values = {
        "micro_f1": c("f1"), "coverage": ratio(c("n"), c("known")), "mae_penalised": c("mae"), "coupling": (c("f1") + 1 - c("mae")) / 2,
        "weighted_kappa": F.when((c("n") > 0) & (c("chance") != 0), 1 - c("seen") * c("n") / c("chance")), "icc": F.when((c("n") > 1) & (F.abs("down") > 1e-15), (c("msr") - c("mse")) / c("down")),
    }
    long = s.select("rep", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("x")) for k, v in values.items()])).alias("e")).select("rep", "e.metric", "e.x")
    return _ends(long, "metric")


def prediction_violations(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """``case_id, violation``: predictions of no case (``extra``) and cases predicted more than once (``repeated``)."""
    n = predictions.groupBy("case_id").agg(F.count("*").alias("n")).join(cases.select("case_id").distinct().withColumn("_known", F.lit(True)), "case_id", "left")
    return n.select("case_id", F.when(F.col("_known").isNull(), "extra").when(F.col("n") > 1, "repeated").alias("violation")).where("violation is not null")
