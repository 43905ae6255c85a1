"""Operator 12, mixing sources to target weights by subset sums over exact lengths.

Every source gets a share of the budget by its weight, up to ``cap`` times its own size; what
is over is shared again by weight. With the budget at or above its size a source is taken as
a whole (as often as it fits), and a subset of its documents fills the rest:

1. The documents are counted by their exact length. Each length gives its proportional
   number of documents, rounded down, so that the subset is like the source.
2. Single documents, lengths in a seeded order, use up what the rounding left, but for a
   small remainder of about ``WINDOW`` words.
3. A bounded-knapsack table over the remaining counts finds the sum nearest to the
   remainder (nearly always the remainder itself), and the lengths that make it.
4. Of every length, the documents of smallest seeded hash are taken, as many as counted.

Only (id, source, length, hash) rows are shuffled. A source's task sees its distinct lengths,
not its documents. A length that a large part of a source shares is dealt to buckets of
about ``BUCKET`` rows by the hash; only the bucket in which the count ends is ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlytics.llm.common import register, stored, table
from postlytics.operators.encode import global_rank
from postlytics.session import ship_package

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = 42
WINDOW = 4096          # words left to the knapsack
BUCKET = 4096          # rows ranked together
PLAN_ROWS = 200_000    # (source, length) rows broadcast at most; more are joined under salts
SALTS = 16


def water_level(sources: DataFrame, budget: float, cap: int) -> float:
    """The words per unit of weight at which the sources (source_size, weight), none above
    ``cap`` times its size, use up the budget. One aggregate a round; every round but the
    last caps another source, and most cap many."""
    level, capped = 0.0, -1
    size, weight = F.col("source_size"), F.col("weight")
    while True:
        over = size * cap < weight * level
        r = sources.agg(F.count_if(over).alias("n"), F.sum(F.when(over, size * cap)).alias("held"),
                        F.sum(F.when(~over, weight)).alias("free")).first()
        if r.n == capped or not r.free:
            return level if r.free else float("inf")
        capped, level = r.n, (budget - (r.held or 0)) / r.free


def source_targets(sized: DataFrame, weights, share: float, cap: int) -> DataFrame:
    """(source, source_size, weight, target) of rows (source, size)."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_rank(sources, [F.col("source").asc_nulls_last()], "place")
    turn = F.array(*map(F.lit, weights))
    ranked = ranked.select("source", "source_size",
                           F.get(turn, F.col("place") % len(weights)).alias("weight"))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(ranked, share * total, cap)
    most = (F.col("source_size") * cap).cast("double")
    return ranked.withColumn("target", F.least(most, F.col("weight") * F.lit(level)))


def nearest_sum(items: list[tuple[int, int]], want: int) -> dict[int, int]:
    """Bounded knapsack: of (size, count) items the numbers whose sum is nearest to ``want``
    (the smaller of two). Reachable sums are the bits of an integer, an item of many copies is
    several of 1, 2, 4, ... copies, all of the
    fewest first; stops when ``want`` is reached."""
    limit = (1 << (2 * want + 1)) - 1
    reach, steps, part = 1, [], 1
    left = [(size, min(count, 2 * want // size)) for size, count in items]
    while left and not reach >> want & 1:
        for size, count in left:
            k = min(part, count)
            new = reach | (reach << (k * size)) & limit
            if new != reach:
                steps.append((size, k, reach))
                reach = new
            if reach >> want & 1:
                break
        left = [(size, count - part) for size, count in left if count > part]
        part *= 2
    below = (reach & ((1 << (want + 1)) - 1)).bit_length() - 1
    above = reach >> (want + 1)
    at = below
    if above and (up := want + (above & -above).bit_length()) - want < want - below:
        at = up
    taken: dict[int, int] = {}
    for size, k, before in reversed(steps):
        if not before >> at & 1:
            taken[size] = taken.get(size, 0) + k
            at -= k * size
    return taken


def fit_lengths(sizes: list[int], counts: list[int], want: int, order: list[int]) -> list[int]:
    """How many documents of each distinct size to take, so that their words come as near to
    ``want`` as the counts allow; ``order`` holds the indices in seeded order."""
    total = sum(s * c for s, c in zip(sizes, counts, strict=True))
    if want >= total:
        return list(counts)
    picks = [c * want // total for c in counts]
    rest = want - sum(s * p for s, p in zip(sizes, picks, strict=True))
    for i in order:
        if 0 < sizes[i] <= rest - WINDOW and picks[i] < counts[i]:
            picks[i] += 1
            rest -= sizes[i]
    at = {s: i for i, s in enumerate(sizes)}
    free = [(sizes[i], counts[i] - picks[i]) for i in order
            if 0 < sizes[i] <= 2 * rest and picks[i] < counts[i]]
    for s, k in nearest_sum(free, rest).items():
        picks[at[s]] += k
    return picks


PLAN = ("source string, size long, n long, pick long, base long, source_size long, target double")


def _plan(hist: DataFrame, seed: int) -> DataFrame:
    """``PLAN`` rows of (source, size, n, source_size, target, order): every length's documents
    are all taken ``base`` times, and ``pick`` of them once more."""
    def fit(pdf):
        import pandas as pd

        pdf = pdf.sort_values("size")
        whole, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        aim = int(target + 0.5)
        base = aim // whole if whole else 0
        picks = fit_lengths(pdf["size"].tolist(), pdf["n"].tolist(), aim - base * whole,
                            pdf["order"].argsort(kind="stable").tolist())
        return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "n": pdf["n"], "pick": picks,
                             "base": base, "source_size": whole, "target": target})

    return (hist.withColumn("order", F.xxhash64(F.lit(seed), "size"))
            .groupBy("source").applyInPandas(fit, PLAN))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = SEED,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, h (hash of the text), source, size (words), source_size,
    target (words of its source's share) and times (how often the mix takes it, 0 to ``cap``).

    Sources in code-point order, null last, have the weights in turn. Null texts have no words;
    documents without words are never taken once more. Null ids count as one id; rows repeated in full are
    rows of their own. Other columns are ignored; an empty table gives an empty result. The same
    rows give the same mix, in whatever order they come.
    """
    if cap < 1 or not all(w > 0 for w in weights):
        raise ValueError("cap at least 1, weights above 0")
    ship_package(docs.sparkSession)
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    h = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    sized = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"),
                               F.col(source_col).alias("source"), words.cast("long").alias("size"), h.alias("h"),
                               F.xxhash64(F.lit(seed), F.col(id_col), h).alias("draw")))
    hist = stored(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    targets = source_targets(hist.select("source", (F.col("size") * F.col("n")).alias("size")),
                             weights, share, cap)
    plan = stored(_plan(_same_source(hist, targets.select("source", "source_size", "target")), seed))
    # every row meets its length's counts
    if plan.count() <= PLAN_ROWS:
        met = _same_source(sized, F.broadcast(plan), "size")
    else:
        salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("draw", F.lit(1)), F.lit(SALTS)).cast("int")
        met = _same_source(sized.withColumn("salt", salt), salted, "size", "salt").drop("salt")
    part = (F.col("pick") > 0) & (F.col("pick") < F.col("n")) & (F.col("size") > 0)
    spread = F.ceil(F.col("n") / BUCKET)
    bucket = F.shiftrightunsigned("draw", 33) * spread / (1 << 31)
    met = stored(met.withColumn("bucket", F.when(part, F.floor(bucket)).otherwise(-1)))
    whole = met.where(~part).withColumn("more", F.when(F.col("pick") > 0, 1).otherwise(0))
    some = met.where(part)
    keys = ["source", "size", "bucket"]
    inside = some.groupBy(*keys).agg(F.count("*").alias("inside"))
    before = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    upto = inside.withColumn("before", F.coalesce(F.sum("inside").over(before), F.lit(0))).drop("inside")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("draw", F.col("doc_id").asc_nulls_last(), "h"))
    ranked = (_same_source(some, upto, "size", "bucket").withColumn("rank", rank)
              .withColumn("more", F.when(F.col("rank") <= F.col("pick") - F.col("before"), 1).otherwise(0)))
    cols = ["doc_id", "h", "source", "size", "source_size", "target",
            (F.when(F.col("size") > 0, F.col("base") + F.col("more")).otherwise(0)).alias("times")]
    return whole.select(*cols).unionByName(ranked.select(*cols))


def _same_source(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Inner join on a nullable source and further keys; ``right``'s other columns are added."""
    a, b = left.alias("a"), right.alias("b")
    on = F.col("a.source").eqNullSafe(F.col("b.source"))
    for k in keys:
        on &= F.col(f"a.{k}") == F.col(f"b.{k}")
    return a.join(b, on).select("a.*", *[F.col(f"b.{c}") for c in right.columns
                                        if c not in ("source", *keys)])


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` as often as ``mix`` takes them, all columns."""
    taken = mix(docs, id_col=id_col, text_col=text_col, **how)
    # rows repeated in full are told apart by nothing: their numbers are added up
    source = how.get("source_col", "source")
    sums = (taken.groupBy("doc_id", "h", "source").agg(F.sum("times").alias("times"), F.count("*").alias("rows"))
            .where("times > 0").alias("g"))
    h = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.withColumn("_h", h).alias("d")
    met = rows.join(sums, F.col(f"d.{id_col}").cast("long").eqNullSafe(F.col("g.doc_id"))
                    & (F.col("d._h") == F.col("g.h"))
                    & F.col(f"d.{source}").eqNullSafe(F.col("g.source")))
    one = Window.partitionBy("g.doc_id", "g.h", "g.source").orderBy(*[F.col(f"d.{c}") for c in docs.columns])
    # the first rows of a set of copies are taken once more than the others
    each = F.floor(F.col("g.times") / F.col("g.rows"))
    extra = F.when(F.row_number().over(one) <= F.col("g.times") % F.col("g.rows"), 1).otherwise(0)
    return (met.withColumn("_times", (each + extra).cast("int")).where("_times > 0")
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
            .select(*[F.col(f"d.{c}") for c in docs.columns]))


@register("op12_budget_mixing")
def op12_budget_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights 5, 2, 1 of their sources, 150 % of the words in all.
    SQL has no knapsack over integers of any size: the tests check the targets in SQL, and the
    sums against brute force."""
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target",
                      (F.col("size") * F.col("times")).alias("taken"))
