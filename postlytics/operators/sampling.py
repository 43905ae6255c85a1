"""Exact stratified and few-shot sampling.

Order of draw: every row gets ``md5(id || ':' || seed)`` (the same hex in
Spark and in SQL engines), and a class keeps its ``quota`` smallest rows by
``(hash, id)``. This is exact, seeded, and independent of partitioning.

Scale: a class may hold a third of all rows, so the per-class ranking is
never done as one window over the whole class. A 1024-bucket histogram of
the hash prefix (one aggregation pass, tiny result) finds, per class, the
bucket in which the quota boundary falls; rows below it are in, rows above
it are out, and only the boundary bucket is ranked with a window. The
histogram is refined until the boundary bucket is small, so the ranked
group stays bounded however large the class is.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIST_BUCKETS = 1024
MAX_BOUNDARY_ROWS = 200_000
_P_MAX = 1 << 32


def draw_hash(id_col: str, seed: int) -> Column:
    """Seeded per-row hash: md5 hex of ``'<id>:<seed>'``."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def _prefix(h: Column) -> Column:
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long")


def _case(group_col: str, values: Mapping, default) -> Column:
    expr = None
    for k, v in values.items():
        cond = F.col(group_col) == F.lit(k)
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)


def smallest_per_group(df: DataFrame, group_col: str, quotas: Mapping, id_col: str,
                       seed: int = 42) -> DataFrame:
    """Rows whose rank by ``(md5 hash, id)`` within ``group_col`` is <= quota.

    ``quotas`` maps each group value to its quota (groups not listed get 0).
    """
    hashed = (df.withColumn("_h", draw_hash(id_col, seed))
                .withColumn("_p", _prefix(F.col("_h"))))
    lo = {k: 0 for k in quotas}
    hi = {k: _P_MAX for k in quotas}
    need = {k: int(q) for k, q in quotas.items()}
    while True:
        active = [k for k in need if need[k] > 0 and hi[k] - lo[k] > 1]
        if not active:
            break
        lo_c = _case(group_col, lo, 0)
        hi_c = _case(group_col, hi, 0)
        width = hi_c - lo_c
        in_range = (F.col("_p") >= lo_c) & (F.col("_p") < hi_c)
        bucket = F.floor((F.col("_p") - lo_c) * HIST_BUCKETS / width).cast("int")
        hist = (hashed.where(F.col(group_col).isin(active) & in_range)
                .groupBy(group_col, bucket.alias("b")).count().collect())
        per = {}
        for r in hist:
            per.setdefault(r[group_col], []).append((r["b"], r["count"]))
        changed = False
        for k in active:
            cells = sorted(per.get(k, []))
            total = sum(c for _, c in cells)
            if total <= MAX_BOUNDARY_ROWS or total <= need[k]:
                continue
            acc = 0
            for b, c in cells:
                if acc + c >= need[k]:
                    w = hi[k] - lo[k]
                    b_lo = lo[k] + (b * w + HIST_BUCKETS - 1) // HIST_BUCKETS
                    b_hi = lo[k] + ((b + 1) * w + HIST_BUCKETS - 1) // HIST_BUCKETS
                    need[k] -= acc
                    lo[k], hi[k] = b_lo, b_hi
                    changed = True
                    break
                acc += c
        if not changed:
            break
    lo_c = _case(group_col, lo, 0)
    hi_c = _case(group_col, hi, 0)
    need_c = _case(group_col, need, 0)
    sure = hashed.where(F.col("_p") < lo_c)
    boundary = hashed.where((F.col("_p") >= lo_c) & (F.col("_p") < hi_c) & (need_c > 0))
    w = Window.partitionBy(group_col).orderBy("_h", id_col)
    ranked = (boundary.withColumn("_rn", F.row_number().over(w))
              .where(F.col("_rn") <= need_c).drop("_rn"))
    return sure.unionByName(ranked).drop("_h", "_p")


def _class_counts(df: DataFrame, label_col: str) -> dict:
    return {r[0]: r[1] for r in df.groupBy(label_col).count().collect()}


def stratified_quotas(counts: Mapping, sample_size: int) -> dict:
    """Per-class quota proportional to the class share; the leftover goes to
    the largest remainders (ties: smaller label first)."""
    n = sum(counts.values())
    labels = sorted(counts)
    floor = {k: sample_size * counts[k] // n for k in labels}
    rem = {k: sample_size * counts[k] % n for k in labels}
    left = sample_size - sum(floor.values())
    for k in sorted(labels, key=lambda k: (-rem[k], k))[:left]:
        floor[k] += 1
    return floor


def stratified_sample(df: DataFrame, label_col: str, sample_size: int,
                      id_col: str = "post_id", seed: int = 42) -> DataFrame:
    """Exact-size stratified sample (columns kept, features then label)."""
    counts = _class_counts(df, label_col)
    if any(v < 2 for v in counts.values()):
        raise ValueError("every class needs at least 2 rows for a stratified split")
    n = sum(counts.values())
    if sample_size < len(counts) or n - sample_size < len(counts):
        raise ValueError("sample and rest must each hold at least one row per class")
    quotas = stratified_quotas(counts, sample_size)
    out = smallest_per_group(df, label_col, quotas, id_col, seed)
    cols = [c for c in df.columns if c != label_col] + [label_col]
    return out.select(*cols)


def few_shot_sample(df: DataFrame, k: int, label_col: str = "label",
                    id_col: str = "post_id", seed: int = 42) -> DataFrame:
    """``k // classes`` rows per class, the rest of ``k`` from all other rows.

    Adds ``shot`` (1..k): the order in which the examples are listed.
    """
    counts = _class_counts(df, label_col)
    per = k // len(counts)
    if any(v < per for v in counts.values()):
        raise ValueError("a class has fewer rows than the per-class quota")
    picked = (smallest_per_group(df, label_col, {c: per for c in counts}, id_col, seed)
              .withColumn("_part", F.lit(0)))
    rem = k - per * len(counts)
    if rem > 0:
        rest = (df.join(picked.select(id_col), id_col, "left_anti")
                .withColumn("_h", draw_hash(id_col, seed))
                .orderBy("_h", id_col).limit(rem).drop("_h")
                .withColumn("_part", F.lit(1)))
        picked = picked.unionByName(rest)
    # listing order: class by class (label order) in draw order, remainder last.
    # The window runs over the k picked rows only.
    order = Window.orderBy("_part", F.when(F.col("_part") == 0, F.col(label_col)),
                           "_h", id_col)
    return (picked.withColumn("_h", draw_hash(id_col, seed))
            .withColumn("shot", F.row_number().over(order))
            .drop("_h", "_part"))


def few_shot_samples(df: DataFrame, ks, label_col: str = "label", id_col: str = "post_id",
                     seed: int = 42, keep=()) -> dict:
    """E2 for several ``k`` in one pass: ``{k: [rows in listing order]}``.

    Every k's draw is a prefix of the same hash order, so the rows any k can
    use are the first ``max(k) // classes`` of each class plus the first
    ``max(k) + classes`` rows overall. Only that bounded candidate set
    (at most about ``2 * max(k) + classes`` rows) is fetched; each k is
    then resolved on it exactly as :func:`few_shot_sample` would.
    """
    counts = _class_counts(df, label_col)
    n_cls = len(counts)
    k_max = max(ks)
    q_max = k_max // n_cls
    # the draw sees ids, labels and a hash of the columns to keep; these are fetched for the
    # candidates only
    rows = df.select(id_col, label_col, *keep).withColumn("_key", F.xxhash64(*keep) if keep else F.lit(0))
    light = rows.select(id_col, label_col, "_key")
    per_class = smallest_per_group(light, label_col, {c: q_max for c in counts}, id_col, seed)
    overall = (light.withColumn("_h", draw_hash(id_col, seed)).orderBy("_h", id_col)
               .limit(k_max + n_cls).drop("_h"))
    drawn = per_class.unionByName(overall).distinct().toDF("_id", "_label", "_drawn")
    cand = (rows.join(F.broadcast(drawn), F.col(id_col).eqNullSafe(F.col("_id"))
                      & F.col(label_col).eqNullSafe(F.col("_label")) & (F.col("_key") == F.col("_drawn")), "left_semi")
            .drop("_key").distinct().withColumn("_h", draw_hash(id_col, seed)).collect())
    cand.sort(key=lambda r: (r["_h"], r[id_col]))
    out = {}
    for k in ks:
        per = k // n_cls
        if any(v < per for v in counts.values()):
            raise ValueError("a class has fewer rows than the per-class quota")
        picked, seen = [], {}
        for r in cand:
            c = r[label_col]
            if seen.get(c, 0) < per:
                seen[c] = seen.get(c, 0) + 1
                picked.append(r)
        picked.sort(key=lambda r: (r[label_col], r["_h"], r[id_col]))
        chosen = {r[id_col] for r in picked}
        rest = [r for r in cand if r[id_col] not in chosen][: k - per * n_cls]
        out[k] = picked + rest
    return out
