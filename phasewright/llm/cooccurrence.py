"""Items that appear together more often than their own frequencies explain."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phasewright.operators.graph import numbered
from phasewright.plans.tables import keep

#: Items of a record that one block holds; larger records are cut into blocks, and pairs of blocks are matched as rows of their own.
BLOCK = 64
#: Rows of a record beyond which only pairs of items that many such records have are made; the others are looked up.
GIANT = 4096
#: Item degrees above this are put together with those at most 1 % away, which bounds the classes of the null model.
EXACT_DEGREE = 4096
#: The same for the sizes of records, whose classes travel with every pair that is tested.
EXACT_SIZE = 128
#: Width of a p-value class in the false-discovery control, as a power of e.
BIN = 0.01
MAX_BIN = 80_000


def fit_null(items: np.ndarray, n_items: np.ndarray, records: np.ndarray, n_records: np.ndarray, rounds: int = 2000, tol: float = 1e-8):
    """Fitness of item and record degree classes under the bipartite configuration model.

    Item class i and record class r meet with probability x*y/(1+x*y); the
    expected degrees equal the given ones.  Zero degrees get fitness zero.
    """
    edges = float((items * n_items).sum())
    x, y = items / math.sqrt(max(edges, 1)), records / math.sqrt(max(edges, 1))
    for _ in range(rounds):
        meet = 1 / (1 + np.outer(x, y))
        x_new = items / np.maximum((n_records * y * meet).sum(1), 1e-300)
        meet = 1 / (1 + np.outer(x_new, y))
        y_new = records / np.maximum((n_items * x_new * meet.T).sum(1), 1e-300)
        moved = max(np.abs(x_new / np.maximum(x, 1e-300) - 1).max(initial=0), np.abs(y_new / np.maximum(y, 1e-300) - 1).max(initial=0))
        x, y = np.minimum(x_new, 1e12), np.minimum(y_new, 1e12)
        if moved < tol:
            break
    return x, y


def log_tail(seen: np.ndarray, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log P(X >= seen) for sums of n[j] independent trials of probability p[i, j], one row per pair.

    The Poisson-binomial tail by the saddle-point formula of Lugannani and Rice
    with its continuity correction; at or below the mean, where no pair is a
    surprise, the normal approximation is enough.
    """
    seen = seen.astype(float)
    p = np.clip(p, 0, 1 - 1e-12)
    mean = (n * p).sum(1)
    var = np.maximum((n * p * (1 - p)).sum(1), 1e-300)
    most = (n * (p > 0)).sum(1)
    t = np.zeros(len(seen))
    goal = np.minimum(seen, np.maximum(most - 1e-6, 0))
    low, high = np.zeros(len(seen)), np.full(len(seen), 700.0)
    t = np.clip(np.log(np.maximum(goal, 1e-9) / np.maximum(mean, 1e-300)), 0, 600)
    for _ in range(60):
        e = p * np.exp(np.minimum(t, 690))[:, None]
        q = e / (1 - p + e)
        k1 = (n * q).sum(1)
        k2 = np.maximum((n * q * (1 - q)).sum(1), 1e-300)
        low, high = np.where(k1 < goal, t, low), np.where(k1 < goal, high, t)
        step = t + (goal - k1) / k2
        new = np.where((step > low) & (step < high), step, (low + high) / 2)
        if np.abs(new - t).max(initial=0) < 1e-10:
            break
        t = new
    e = p * np.expm1(np.minimum(t, 690))[:, None]
    k0 = (n * np.log1p(e)).sum(1)
    up = t > 1e-6
    w = np.sqrt(np.maximum(2 * (t * goal - k0), 1e-300))
    u = -np.expm1(-t) * np.sqrt(k2)
    log_phi = -0.5 * w * w - 0.5 * math.log(2 * math.pi)
    mills = _log_upper(w)
    with np.errstate(divide="ignore", invalid="ignore"):
        fix = 1 / np.maximum(u, 1e-300) - 1 / np.maximum(w, 1e-300)
        upper = mills + np.log1p(np.clip(np.exp(log_phi - mills) * fix, -0.999999, None))
    normal = _log_upper((seen - 0.5 - mean) / np.sqrt(var))
    out = np.where(up & (w > 1e-3), upper, normal)
    with np.errstate(divide="ignore"):
        every = (n * np.log(np.maximum(p, 1e-300)) * (p > 0)).sum(1)
    out = np.where(seen >= most, every, out)  # only all trials together reach it
    out = np.where(seen <= 0, 0.0, out)
    return np.minimum(out, 0.0)


def _log_upper(z: np.ndarray) -> np.ndarray:
    """log of the upper tail of the normal distribution."""
    z = np.asarray(z, float)
    out = np.empty(len(z))
    far = z > 5
    if far.any():
        q = z[far]
        out[far] = -0.5 * q * q - np.log(q * math.sqrt(2 * math.pi)) + np.log1p(-1 / q**2 + 3 / q**4 - 15 / q**6 + 105 / q**8)
    near = ~far
    out[near] = np.log(np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in z[near]], float)) if near.any() else 0
    return out


def _fit_scope(pdf: pd.DataFrame) -> pd.DataFrame:
    """The null model of one scope, from its degree classes (never its rows)."""
    of = {kind: pdf[pdf["kind"] == kind].sort_values("degree") for kind in ("item", "record")}
    i, r = of["item"], of["record"]
    x, y = fit_null(i["mean"].to_numpy(float), i["n"].to_numpy(float), r["mean"].to_numpy(float), r["n"].to_numpy(float))
    return pd.DataFrame(
        {"s": [pdf["s"].iloc[0]], "item_class": [i["degree"].tolist()], "item_fitness": [x.tolist()], "record_fitness": [y.tolist()], "record_n": [r["n"].astype(float).tolist()]}
    )


#: Parts into which the tails of one scope are spread; its model is copied to each.
PARTS = 16


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Expected count and log tail of each kind of pair; in every part of a scope its model comes first."""
    y = n = None
    for batch in batches:
        cols = batch.to_pydict()
        is_model = np.array([a is not None for a in cols["record_fitness"]], bool)
        keep_rows = np.flatnonzero(~is_model)
        expected, logp = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
        cuts = np.flatnonzero(is_model).tolist() + [batch.num_rows]
        begin = 0
        for cut in cuts:
            for part in np.array_split(np.arange(begin, cut), max(1, (cut - begin) // 2000)) if cut > begin else []:
                qa, qb = (np.outer(np.array([cols[c][k] for k in part]), y) for c in ("x_lo", "x_hi"))
                p = qa / (1 + qa) * qb / (1 + qb)
                expected[part] = (n * p).sum(1)
                logp[part] = log_tail(np.array([cols["n_both"][k] for k in part]), p, n)
            if cut < batch.num_rows:
                y, n = np.asarray(cols["record_fitness"][cut], float), np.asarray(cols["record_n"][cut], float)
            begin = cut + 1
        out = batch.take(pa.array(keep_rows))
        names = ["s", "class_lo", "class_hi", "n_both", "k"]
        yield pa.RecordBatch.from_arrays([*[out.column(c) for c in names], pa.array(expected[keep_rows]), pa.array(logp[keep_rows])], names=[*names, "expected", "log_p"])


def _degree_class(degree, exact):
    """The degree itself up to ``exact``, beyond it the start of its 1 % class."""
    step = F.floor(F.log(degree / F.lit(exact)) / math.log(1.01))
    return F.when(degree <= exact, degree).otherwise(F.floor(F.lit(exact) * F.pow(F.lit(1.01), step)).cast("long") + 1)


class Together:
    """``counts``: lo, hi (numbers of items, in their order), n_both; ``items``: number, s, i, n, class; ``sizes``: s, degree, n, mean of the records."""

    def __init__(self, counts: DataFrame, items: DataFrame, sizes: DataFrame):
        self.counts, self.items, self.sizes = counts, items, sizes

    def named(self, counts: DataFrame) -> DataFrame:
        """``counts`` with s, the items themselves as lo and hi, their counts and classes, and the number of records."""
        records = self.sizes.groupBy("s").agg(F.sum("n").alias("n_records")).withColumnRenamed("s", "rs")
        out = counts.withColumnsRenamed({"lo": "number_lo", "hi": "number_hi"})
        for side in ("lo", "hi"):
            own = self.items.select(F.col("number").alias(f"number_{side}"), F.col("i").alias(side), F.col("n").alias(f"n_{side}"), F.col("class").alias(f"class_{side}"), *(["s"] if side == "lo" else []))
            out = out.join(own, f"number_{side}")
        return out.join(records, F.col("s").eqNullSafe(F.col("rs"))).select("s", "lo", "hi", "n_both", "n_lo", "n_hi", "n_records", "class_lo", "class_hi")


def count_together(rows: DataFrame, scope: str, record: str, item: str, min_count: int = 2, block: int = BLOCK, giant: int = GIANT) -> Together:
    """All pairs of different items that meet in at least ``min_count`` records of a scope, counted exactly.

    An item counts once per record; rows with a null record or item are
    ignored, a null scope is a scope.  Items of fewer than ``min_count``
    records are in no such pair and leave before any pair is made; the others
    get numbers, so that what is shuffled of a pair is two of them.

    Records of more than ``block`` rows are cut into blocks by a hash of the
    item; each pair of blocks is a row of its own, so no task has to hold a
    record.  In records of over ``giant`` rows only items that ``min_count`` such
    records have are paired.  Any other pair that reaches ``min_count`` meets in
    a smaller record too, and the pairs of those are looked up in the giants.
    """
    rows = rows.select(F.col(scope).alias("s"), F.col(record).alias("r"), F.col(item).alias("i")).where("r IS NOT NULL AND i IS NOT NULL")
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    large = keep(rows.groupBy("s", "r").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > block), n=F.count(F.lit(1)), most=F.max("rows"))
    if not large.stats["n"]:
        cut = rows.withColumn("blocks", F.lit(1))
    else:
        cut = rows.alias("a").join(large.df.alias("b"), same("a.s", "b.s") & (F.col("a.r") == F.col("b.r")), "left")
        cut = cut.select("a.s", "a.r", "a.i", F.ceil(F.coalesce(F.col("b.rows"), F.lit(1)) / block).cast("int").alias("blocks"))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("i"), F.col("blocks")).cast("int"))
    baskets = keep(cut.groupBy("s", "r", "blocks", "block").agg(F.collect_set("i").alias("items")).withColumn("id", F.monotonically_increasing_id())).df

    freq = baskets.select("s", F.explode("items").alias("i")).groupBy("s", "i").agg(F.count(F.lit(1)).alias("n")).withColumn("class", _degree_class(F.col("n"), EXACT_DEGREE))
    items = keep(numbered(freq.withColumn("__o", F.struct("s", "i")), "__o", "number").drop("__o")).df
    often = items.where(F.col("n") >= min_count).select(F.col("s").alias("fs"), F.col("i").alias("fi"), "number")
    coded = baskets.select("id", "s", F.explode("items").alias("i")).join(often, same("s", "fs") & (F.col("i") == F.col("fi"))).select("id", "number")
    coded = keep(coded.groupBy("id").agg(F.array_sort(F.collect_list("number")).alias("items"))).df

    def within(lists: DataFrame) -> DataFrame:
        at = lists.where(F.size("items") > 1).select("items", F.posexplode("items").alias("k", "lo"))
        return at.select("lo", F.explode(F.slice("items", F.col("k") + 2, F.size("items"))).alias("hi"))

    def across(lists: DataFrame) -> DataFrame:
        a, b = lists.alias("a"), lists.alias("b")
        met = a.join(b, same("a.s", "b.s") & (F.col("a.r") == F.col("b.r")) & (F.col("a.block") < F.col("b.block"))).select(F.col("b.items").alias("other"), F.explode("a.items").alias("x"))
        met = met.select("x", F.explode("other").alias("y"))
        return met.select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"))

    if not large.stats["n"]:
        counts = within(coded).groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n_both")).where(F.col("n_both") >= min_count)
    else:
        cuts = keep(coded.join(baskets.where("blocks > 1").select("id", "s", "r", "blocks", "block"), "id")).df
        wide = cuts.where(F.col("blocks") * block <= giant)
        small = coded.join(baskets.where("blocks = 1").select("id"), "id", "left_semi").select("items").unionByName(wide.select("items"))
        pairs = within(small).unionByName(across(wide)).groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n_both"))
        if large.stats["most"] > giant:
            huge = cuts.where(F.col("blocks") * block > giant)
            inside = huge.select("s", "r", "block", F.explode("items").alias("i"))
            per = inside.groupBy("i").agg((F.count(F.lit(1)) >= min_count).alias("paired"))
            inside = keep(inside.join(per, "i")).df
            own = keep(inside.where("paired").groupBy("s", "r", "block").agg(F.array_sort(F.collect_list("i")).alias("items"))).df
            both = within(own.select("items")).unionByName(across(own)).groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n_both"))
            pairs = keep(pairs).df
            side = lambda name: inside.select(F.col("s").alias(f"s_{name}"), F.col("r").alias(f"r_{name}"), F.col("i").alias(name), F.col("paired").alias(f"p_{name}"))
            seen = pairs.select("lo", "hi").join(side("lo"), "lo").withColumnRenamed("hi", "want")
            seen = seen.join(side("hi"), same("s_lo", "s_hi") & (F.col("r_lo") == F.col("r_hi")) & (F.col("want") == F.col("hi"))).where("NOT (p_lo AND p_hi)")
            seen = seen.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n_both"))
            pairs = pairs.unionByName(both).unionByName(seen).groupBy("lo", "hi").agg(F.sum("n_both").alias("n_both"))
        counts = pairs.where(F.col("n_both") >= min_count)

    degree = lambda d: _degree_class(F.col(d), EXACT_SIZE).alias("degree")
    one = baskets.where("blocks = 1").select("s", F.size("items").alias("d"))
    more = baskets.where("blocks > 1").groupBy("s", "r").agg(F.sum(F.size("items")).alias("d")).select("s", F.col("d").cast("int").alias("d"))
    sizes = one.unionByName(more).groupBy("s", degree("d")).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"))
    return Together(keep(counts).df, items, keep(sizes).df)


def pairs_together(rows: DataFrame, scope: str, record: str, item: str, min_count: int = 2, block: int = BLOCK, giant: int = GIANT) -> DataFrame:
    """The pairs of ``count_together`` with the surprise of each.

    Columns: s (scope), lo, hi (items, lo < hi), n_both, n_lo, n_hi, n_records,
    expected (by the null), log_p (log tail), log_q (log of the false-discovery
    rate among all pairs of items of the scope, rounded up to a class of 1 %).

    The null is a bipartite configuration model that keeps the expected
    frequency of every item and the expected size of every record.  It is
    fitted per scope on classes of equal degree: at most sqrt(2 * rows) of them
    exist up to ``EXACT_DEGREE`` (``EXACT_SIZE`` for records), and about 70 for
    each doubling beyond.  A tail depends on the classes of the two items and
    their count alone, so it is computed once for each such kind of pair, where
    a copy of the scope's model comes first.
    """
    together = count_together(rows, scope, record, item, min_count, block, giant)
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    classes = together.items.groupBy("s", F.col("class").alias("degree")).agg(F.count(F.lit(1)).alias("n"), F.avg("n").alias("mean")).withColumn("kind", F.lit("item"))
    classes = keep(classes.unionByName(together.sizes.withColumn("kind", F.lit("record")))).df
    kind = together.items.schema["s"].dataType.simpleString()
    model = keep(classes.groupBy("s").applyInPandas(_fit_scope, f"s {kind}, item_class array<long>, item_fitness array<double>, record_fitness array<double>, record_n array<double>")).df
    n_items = classes.where("kind = 'item'").groupBy("s").agg(F.sum("n").alias("n_items"))

    pairs = keep(together.named(together.counts)).df
    key = ["s", "class_lo", "class_hi", "n_both"]
    kinds = pairs.groupBy(*key).agg(F.count(F.lit(1)).alias("k"))
    fitness = model.select(F.col("s").alias("xs"), F.explode(F.arrays_zip("item_class", "item_fitness")).alias("x")).select("xs", F.col("x.item_class").alias("xc"), F.col("x.item_fitness").alias("x"))
    for side in ("lo", "hi"):
        g = fitness.select(F.col("xs").alias("gs"), F.col("xc").alias("gc"), F.col("x").alias(f"x_{side}"))
        kinds = kinds.join(g, same("s", "gs") & (F.col(f"class_{side}") == F.col("gc"))).drop("gs", "gc")
    none = lambda t: F.lit(None).cast(t)
    work = kinds.select(*key, "k", "x_lo", "x_hi", none("array<double>").alias("record_fitness"), none("array<double>").alias("record_n"), F.pmod(F.xxhash64("class_lo", "class_hi", "n_both"), F.lit(PARTS)).cast("int").alias("part"))
    heads = model.select("s", *[none("long").alias(c) for c in (*key[1:], "k")], *[none("double").alias(c) for c in ("x_lo", "x_hi")], "record_fitness", "record_n", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    work = work.unionByName(heads).repartition("s", "part").sortWithinPartitions("s", "part", F.col("record_fitness").isNull())
    tails = keep(work.mapInArrow(_tails, f"s {kind}, class_lo long, class_hi long, n_both long, k long, expected double, log_p double").withColumn("bin", F.least(F.floor(-F.col("log_p") / BIN), F.lit(MAX_BIN)).cast("int"))).df
    rated = _false_discovery(tails, n_items).select(*[F.col(c).alias(f"t_{c}") for c in key], "expected", "log_p", "log_q")
    out = pairs.join(rated, same("s", "t_s") & (F.col("class_lo") == F.col("t_class_lo")) & (F.col("class_hi") == F.col("t_class_hi")) & (F.col("n_both") == F.col("t_n_both")))
    return out.select("s", "lo", "hi", "n_both", "n_lo", "n_hi", "n_records", "expected", "log_p", "log_q")


def _false_discovery(tails: DataFrame, scopes: DataFrame) -> DataFrame:
    """``tails`` with log_q: Benjamini-Hochberg over classes of p-values; ``k`` pairs of each kind stand for the ranks.

    A class takes its largest p-value, so rates are too high by 1 % at most and
    never too low.  There are at most MAX_BIN classes a scope.
    """
    per = tails.groupBy("s", "bin").agg(F.sum("k").alias("k"))
    per = per.join(scopes.withColumnRenamed("s", "cs"), F.col("s").eqNullSafe(F.col("cs"))).drop("cs")
    strong = Window.partitionBy("s").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    weaker = Window.partitionBy("s").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tests = F.col("n_items").cast("double") * (F.col("n_items") - 1) / 2
    rate = -F.col("bin") * BIN + F.log(tests) - F.log(F.sum("k").over(strong).cast("double"))
    per = per.withColumn("rate", rate).withColumn("log_q", F.least(F.lit(0.0), F.min("rate").over(weaker)))
    per = per.select(F.col("s").alias("ps"), F.col("bin").alias("pb"), "log_q")
    return tails.join(per, F.col("s").eqNullSafe(F.col("ps")) & (F.col("bin") == F.col("pb"))).drop("ps", "pb", "bin")


def contig_rows(alignments: DataFrame) -> DataFrame:
    """(library_id, qname, rname) of the alignments that count.

    Unmapped, secondary and duplicate alignments, rows without a read or
    contig, and a contig ``*`` are ignored; a null flag has no bits set.
    """
    return alignments.where("rname <> '*' AND (coalesce(flag, 0) & 1284) = 0").select("library_id", "qname", "rname")


def contigs_together(alignments: DataFrame, min_count: int = 5) -> DataFrame:
    """Pairs of contigs that meet in the same reads of a library, with their surprise."""
    return pairs_together(contig_rows(alignments), "library_id", "qname", "rname", min_count)
