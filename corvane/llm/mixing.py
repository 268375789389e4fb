"""Records of several sources mixed to target shares of all tokens.

Every source gets a budget of tokens, its share of the total asked for (by default, all tokens of the targeted sources). A
source can give its tokens ``max_repeats`` times at most: one whose share asks for more gives all of that and falls short,
and what it lacks goes to the other sources in proportion to their shares. So a small source never lowers the total, which
is missed only if every source is exhausted. The report shows target, planned and reached shares and the shortfall.

Within a source complete epochs come first; what they leave of the budget is drawn by Efraimidis-Spirakis sampling: each
document has an exponential key divided by its quality weight, documents are taken in the order of their keys, and running
sums of tokens are cut at the budget.

The cut is found by sums over ranges of keys, narrowed until the range that holds it has few documents: only that range is
put in order, so no source is sorted in one task, however large.

Defined results: a target without documents, or with a cap of 0, can't be met: its planned share is 0. Sources without a
target, and texts without tokens, aren't used. A document given twice is drawn twice. Targets of one source spelt
differently add up, with the smallest of their caps; a NULL share counts as 0 and a NULL cap as 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import small_rows

#: Documents that a range of keys may hold to be put in order by one task; with more, it is narrowed further.
ORDERED = 200_000
#: Bits of a key that every narrowing fixes, and bits of a whole key.
STEP_BITS, KEY_BITS = 10, 50

_PLAN = "source string, target_share double, effective_share double, max_repeats bigint, available bigint, budget bigint, epochs bigint, rest bigint"


def source_name(column: F.Column) -> F.Column:
    """Letter case, outer blanks and the kind of dash don't distinguish sources."""
    return F.lower(F.regexp_replace(F.translate(column, "_", "-"), r"^[\s ]+|[\s ]+$", ""))


def quality(text: F.Column) -> F.Column:
    """A weight in [0.05, 1]: the share of letters and blanks in a text, less for very short texts."""
    size = F.length(text)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{M} ]", ""))
    return F.greatest(F.lit(0.05), F.coalesce(F.try_divide(letters, size), F.lit(0.0)) * F.least(F.lit(1.0), F.lit(0.2) + size / 400))


def budgets(sources: list[tuple[str, float, int, int]], total: int | None = None) -> list[tuple]:
    """Rows of the plan for (source, target share, cap of repeats, tokens there are).

    Sources fill at the speed of their shares until the total is reached; one that is exhausted stops and the others go on.
    """
    able = [(s, share, cap * available) for s, share, cap, available in sources if share > 0 and cap * available > 0]
    whole = sum(available for _, share, cap, available in sources if share > 0 and cap > 0) if total is None else total
    given: dict[str, int] = {}
    left, shares = float(whole), sum(share for _, share, _ in able)
    for s, share, most in sorted(able, key=lambda x: (x[2] / x[1], x[0])):  # the first to be exhausted first
        given[s] = min(most, int(left * share / shares + 1e-6)) if shares > 0 else 0
        left, shares = left - given[s], shares - share
    planned = sum(given.values())
    out = []
    for s, share, cap, available in sources:
        budget = given.get(s, 0)
        epochs = min(cap, budget // available) if available else 0
        out.append((s, float(share), budget / planned if planned else 0.0, cap, available, budget, epochs, budget - epochs * available))
    return out


def _fractions(keyed: DataFrame, plan: list[tuple]) -> dict[str, tuple[int, int, int]]:
    """Of each source with a fractional part: (first key, last key, tokens ahead) of the range of keys in which the cut lies."""
    spark = keyed.sparkSession
    state = {s: (0, 0, rest) for s, _, _, _, _, _, _, rest in plan if rest > 0}  # source: prefix, bits of it, tokens still wanted
    done: dict[str, tuple[int, int, int]] = {}
    rests = dict((s, rest) for s, _, _, _, _, _, _, rest in plan)
    bits = 0
    while state:
        bits = min(KEY_BITS, bits + STEP_BITS)
        open_ = spark.createDataFrame([(s, p, w) for s, (p, _, w) in state.items()], "source string, prefix bigint, wanted bigint")
        inside = keyed.join(F.broadcast(open_), "source")  # a row for each of the few targets
        before = bits - STEP_BITS
        inside = inside.where(F.shiftright("key", KEY_BITS - before) == F.col("prefix")) if before else inside
        sums = inside.groupBy("source", "wanted", F.shiftright("key", KEY_BITS - bits).alias("range")).agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
        running = sums.withColumn("upto", F.sum("t").over(Window.partitionBy("source").orderBy("range")))  # 1,024 ranges a source
        hit = running.where(F.col("upto") >= F.col("wanted")).groupBy("source").agg(F.min(F.struct("range", "upto", "t", "n")).alias("r"))
        found = {r["source"]: r["r"] for r in hit.collect()}
        for s, (_, _, wanted) in list(state.items()):
            r = found.get(s)
            if r is None:  # rounding: all that is left is wanted
                done[s] = (1 << KEY_BITS, 1 << KEY_BITS, rests[s])
                del state[s]
                continue
            ahead = r["upto"] - r["t"]
            if r["n"] <= ORDERED or bits >= KEY_BITS:
                low = r["range"] << (KEY_BITS - bits)
                done[s] = (low, low + (1 << (KEY_BITS - bits)) - 1, rests[s] - wanted + ahead)
                del state[s]
            else:
                state[s] = (r["range"], bits, wanted - ahead)
    return done


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(drawn, report): drawn (source, doc_id, tokens, repeats); report, a row for each target, with the shares reached.

    ``documents`` has doc_id, source, tokens, weight and is read several times, so callers cut its lineage first. A document
    is drawn in the fractional part if its tokens end within the rest of the budget, or end closer to it than they began.
    """
    spark = documents.sparkSession
    wanted: dict[str, list] = {}
    for r in small_rows(targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats"), "mix_targets"):
        if r["source"] is not None:
            share, cap = max(0.0, r["target_share"] or 0.0), 1 if r["max_repeats"] is None else max(0, r["max_repeats"])
            held = wanted.setdefault(r["source"], [0.0, cap])
            held[0], held[1] = held[0] + share, min(held[1], cap)
    names = spark.createDataFrame([(s,) for s in wanted], "source string")
    sized = documents.where(F.col("tokens") > 0).select("doc_id", source_name(F.col("source")).alias("source"), F.col("tokens").cast("bigint").alias("tokens"), "weight").join(F.broadcast(names), "source")
    sums = sized.groupBy("source").agg(F.sum("tokens").alias("available"), F.max("tokens").alias("largest")).collect()  # a row for each target at most
    totals = {r["source"]: r["available"] for r in sums}
    largest = spark.createDataFrame([(r["source"], r["largest"]) for r in sums], "source string, largest bigint")
    plan = budgets([(s, share, cap, totals.get(s, 0)) for s, (share, cap) in sorted(wanted.items())], total_tokens)
    plans = F.broadcast(spark.createDataFrame(plan, _PLAN))
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    exponential = -F.log(uniform) / F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(1e-9))
    # the logarithm of the key lies within [-37, 25]: its place there as a whole number keeps the order
    keyed = sized.withColumn("key", F.floor((F.log(exponential) + 40) / 70 * float(1 << KEY_BITS)).cast("bigint"))
    cuts = _fractions(keyed, plan)
    ranges = spark.createDataFrame([(s, *cuts.get(s, (-1, -1, 0))) for s, *_ in plan], "source string, low bigint, high bigint, ahead bigint")
    placed = keyed.join(plans, "source").join(F.broadcast(ranges), "source").select("source", "doc_id", "tokens", "key", "epochs", "rest", "max_repeats", "low", "high", "ahead")
    sure = placed.where((F.col("key") < F.col("low")) | (F.col("key") > F.col("high"))).withColumn("part", F.when(F.col("key") < F.col("low"), 1).otherwise(0))
    close = placed.where(F.col("key").between(F.col("low"), F.col("high"))).withColumn("ends", F.col("ahead") + F.sum("tokens").over(Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    decided = close.withColumn("part", F.when((F.col("rest") > 0) & (2 * F.col("ends") - F.col("tokens") <= 2 * F.col("rest")), 1).otherwise(0)).drop("ends")
    repeats = F.least(F.col("epochs") + F.col("part"), F.col("max_repeats")).cast("int")
    drawn = sure.unionByName(decided).select("source", "doc_id", "tokens", repeats.alias("repeats")).where(F.col("repeats") > 0)
    reached = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"), F.count("*").alias("documents"))
    full = spark.createDataFrame(plan, _PLAN).join(reached, "source", "left").join(largest, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    every = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # a row for each target
    report = full.withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens"), every), F.lit(0.0))).select(
        "source", "target_share", "effective_share", "actual_share", "available", "budget", "tokens", "epochs", F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("largest", F.lit(0)).alias("largest"),
        F.round(F.col("target_share") - F.col("actual_share"), 9).alias("shortfall"),
    )
    return drawn, report
