"""Haplotype assignment: free pairs, contact energy, sampled ascent, consensus merging and writing back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasewright.operators.contacts import symmetric
from phasewright.operators.graph import numbered, weak_components
from phasewright.plans.tables import keep


@dataclass(frozen=True)
class PhaserConfig:
    """Parameters of the assignment; ``sweeps`` bounds a sample, the final pass takes three times as many."""

    sweeps: int = 200
    samples: int = 4
    rounds: int = 2
    merge_threshold: float = 0.8
    seed: int = 42
    propagate_always: bool = False


def free_pairs(alts: DataFrame, locked: DataFrame) -> DataFrame:
    """(pair_idx, a, b): alt rows with a < b and neither end locked, numbered in order."""
    own = alts.select(F.col("node_id").alias("a"), F.col("alt_id").alias("b")).where("a < b").distinct()
    fixed = locked.select("node_id").distinct()
    for side in ("a", "b"):
        own = own.join(fixed.withColumnRenamed("node_id", side), side, "left_anti")
    return numbered(own.withColumn("__o", F.struct("a", "b")), "__o", "pair_idx").select("pair_idx", "a", "b")


def node_map(pairs: DataFrame) -> DataFrame:
    """(node_id, meta, side): +1 for the first and -1 for the second node of a pair; the later pair keeps a shared node."""
    side = lambda n, s: F.struct(F.col(n).alias("node_id"), F.lit(s).alias("side"))
    rows = pairs.select("pair_idx", F.explode(F.array(side("a", 1), side("b", -1))).alias("x")).select("pair_idx", "x.*")
    return rows.groupBy("node_id").agg(F.max("pair_idx").alias("meta"), F.max_by("side", F.struct("pair_idx", "side")).alias("side"))


def meta_weights(contacts: DataFrame, nodes: DataFrame, locked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((i, j, w), (i, w)): contact weights between metas, signed by sides, and those to locked nodes, signed by their phase.

    Contacts within a meta and with nodes of neither kind do not count.  Both
    tables are summed once and serve all samples and sweeps.
    """
    sym = symmetric(contacts)
    u = nodes.select(F.col("node_id").alias("u"), F.col("meta").alias("i"), F.col("side").alias("su"))
    v = nodes.select(F.col("node_id").alias("v"), F.col("meta").alias("j"), F.col("side").alias("sv"))
    half = sym.join(u, "u")
    free = half.join(v, "v").where("i <> j").groupBy("i", "j").agg(F.sum(F.col("w") * F.col("su") * F.col("sv")).alias("w"))
    fixed = locked.select(F.col("node_id").alias("v"), F.when(F.col("phase") == 0, 1).otherwise(-1).alias("sv"))
    fixed = fixed.join(nodes.select(F.col("node_id").alias("v")), "v", "left_anti")
    field = half.join(fixed, "v").groupBy("i").agg(F.sum(F.col("w") * F.col("su") * F.col("sv")).alias("w"))
    return free, field


def meta_adjacency(weights: DataFrame) -> DataFrame:
    """(i, j), i < j: metas that share a contact, even one whose weights cancel."""
    return weights.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()


def random_sign(seed: int | Column, sample: Column, meta: Column) -> Column:
    """+1 or -1 by a hash of seed, sample and meta."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    digest = F.md5(F.concat_ws(":", seed.cast("string"), sample.cast("string"), meta.cast("string")))
    return F.when(F.substring(digest, 1, 1) < "8", 1).otherwise(-1)


def flip_delta(signs: DataFrame, weights: DataFrame, field: DataFrame) -> DataFrame:
    """(sample, meta, sign, delta): what flipping each meta adds to the agreement of all contacts."""
    pull = weights.join(signs.select("sample", F.col("meta").alias("j"), F.col("sign").alias("sj")), "j").groupBy("sample", "i").agg(F.sum(F.col("w") * F.col("sj")).alias("pull"))
    out = signs.join(pull.withColumnRenamed("i", "meta"), ["sample", "meta"], "left").join(field.select(F.col("i").alias("meta"), F.col("w").alias("own")), "meta", "left")
    total = F.coalesce("pull", F.lit(0)) + F.coalesce("own", F.lit(0))
    return out.select("sample", "meta", "sign", (-2 * F.col("sign") * total).cast("long").alias("delta"))


def ascend(signs: DataFrame, weights: DataFrame, field: DataFrame, sweeps: int) -> DataFrame:
    """Signs after coordinate ascent, all samples at once.

    In each sweep every meta flips that would gain and would gain more than
    any neighbour (the lower meta on ties).  No two neighbours flip together,
    so agreement never falls, and the end is a point where no single flip
    gains, unless ``sweeps`` comes first.
    """
    state = keep(signs)
    for _ in range(sweeps):
        gain = keep(flip_delta(state.df, weights, field).where("delta > 0"))
        near = weights.select(F.col("i").alias("meta"), "j").join(gain.df.select("sample", F.col("meta").alias("j"), F.col("delta").alias("dj")), "j")
        best = near.groupBy("sample", "meta").agg(F.max(F.struct("dj", (-F.col("j")).alias("nj"))).alias("rival"))
        flips = gain.df.join(best, ["sample", "meta"], "left").where(
            F.col("rival").isNull() | (F.col("delta") > F.col("rival.dj")) | ((F.col("delta") == F.col("rival.dj")) & (-F.col("meta") > F.col("rival.nj")))
        ).select("sample", "meta", F.lit(True).alias("flip"))
        after = keep(
            state.df.join(flips, ["sample", "meta"], "left").select("sample", "meta", F.when(F.col("flip"), -F.col("sign")).otherwise(F.col("sign")).alias("sign"), F.coalesce("flip", F.lit(False)).alias("flip")),
            flips=F.count_if(F.col("flip")),
        )
        gain.drop()
        state.drop()
        state = after
        state.df = state.df.select("sample", "meta", "sign")
        if not after.stats["flips"]:
            break
    return state.df


def agreement(signs: DataFrame, adjacent: DataFrame) -> DataFrame:
    """(i, j, same, samples, agreement): in how many samples adjacent metas have the same sign, and the larger share."""
    s = lambda m, as_: signs.select("sample", F.col("meta").alias(m), F.col("sign").alias(as_))
    both = adjacent.join(s("i", "si"), "i").join(s("j", "sj"), ["sample", "j"])
    per = both.groupBy("i", "j").agg(F.count_if(F.col("si") == F.col("sj")).alias("same"), F.count(F.lit(1)).alias("samples"))
    return per.withColumn("agreement", F.greatest(F.col("same"), F.col("samples") - F.col("same")) / F.col("samples"))


def merged(signs: DataFrame, agreed: DataFrame) -> DataFrame:
    """(meta, rep, rel): metas joined over agreed pairs; the smallest stands for its group, with the majority of relative signs (+1 on ties)."""
    one = F.lit(0).cast("long")
    metas = signs.select("meta").distinct().select(one.alias("graph_id"), F.col("meta").alias("node_id"))
    groups = weak_components(metas, agreed.select(one.alias("graph_id"), F.col("i").alias("src"), F.col("j").alias("dst"))).select(F.col("node_id").alias("meta"), F.col("component").alias("rep"))
    own = signs.join(groups, "meta").join(signs.select("sample", F.col("meta").alias("rep"), F.col("sign").alias("rs")), ["sample", "rep"])
    return own.groupBy("meta", "rep").agg(F.when(F.sum(F.col("sign") * F.col("rs")) >= 0, 1).otherwise(-1).alias("rel"))


def write_back(pairs: DataFrame, signs: DataFrame, locked: DataFrame) -> DataFrame:
    """(node_id, phase): +1 puts a on haplotype 0 and b on 1; the first pair of a node decides, and locked nodes stay."""
    up = F.col("sign") > 0
    side = lambda n, yes: F.struct(F.col(n).alias("node_id"), F.when(up, yes).otherwise(1 - yes).alias("phase"))
    rows = pairs.join(signs.select(F.col("meta").alias("pair_idx"), "sign"), "pair_idx").select("pair_idx", F.explode(F.array(side("a", 0), side("b", 1))).alias("x")).select("pair_idx", "x.*")
    own = rows.groupBy("node_id").agg(F.min_by("phase", F.struct("pair_idx", "phase")).cast("byte").alias("phase"))
    return own.join(locked.select("node_id"), "node_id", "left_anti").unionByName(locked.select("node_id", F.col("phase").cast("byte").alias("phase")))


def propagate(phases: DataFrame, alts: DataFrame, sweeps: int = 4) -> DataFrame:
    """Phases with the opposite one given to nodes without a phase whose alt has one, at most ``sweeps`` steps away."""
    out = phases.select("node_id", "phase")
    for _ in range(sweeps):
        new = alts.join(out.select("node_id"), "node_id", "left_anti").join(out.select(F.col("node_id").alias("alt_id"), "phase"), "alt_id")
        new = new.groupBy("node_id").agg((1 - F.max("phase")).cast("byte").alias("phase"))
        kept = keep(out.unionByName(new), n=F.count(F.lit(1)))
        out = kept.df
    return out


def assign_phases(contacts: DataFrame, alts: DataFrame, locked: DataFrame, config: PhaserConfig = PhaserConfig()) -> DataFrame:  # noqa: B008
    """(node_id, phase) for the locked nodes, the free pairs and what hangs on them.

    Rounds of sampled ascent merge metas that agree in enough samples; a last
    ascent on what remains gives the signs.  Weights between merged metas are
    those of their members, summed with relative signs.  Without free pairs the
    locked nodes are returned as they are, unless ``propagate_always``.
    """
    pairs = keep(free_pairs(alts, locked), n=F.count(F.lit(1)))
    if not pairs.stats["n"]:
        own = locked.select("node_id", F.col("phase").cast("byte").alias("phase"))
        return propagate(own, alts) if config.propagate_always else own
    weights, field = meta_weights(contacts, node_map(pairs.df), locked)
    weights, field = keep(weights).df, keep(field).df
    member = keep(pairs.df.select(F.col("pair_idx").alias("orig"), F.col("pair_idx").alias("meta"), F.lit(1).alias("rel"))).df

    def start(seed: int, samples: int) -> DataFrame:
        metas = member.select("meta").distinct().withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
        return metas.select("sample", "meta", random_sign(seed, F.col("sample"), F.col("meta")).alias("sign"))

    for r in range(config.rounds):
        signs = ascend(start(config.seed ^ (r * 1000), config.samples), weights, field, config.sweeps)
        agreed = agreement(signs, meta_adjacency(weights)).where(F.col("agreement") >= config.merge_threshold)
        to = keep(merged(signs, agreed)).df
        a, b = to.select(F.col("meta").alias("i"), F.col("rep").alias("ri"), F.col("rel").alias("si")), to.select(F.col("meta").alias("j"), F.col("rep").alias("rj"), F.col("rel").alias("sj"))
        weights = keep(
            weights.join(a, "i").join(b, "j").where("ri <> rj").groupBy(F.col("ri").alias("i"), F.col("rj").alias("j")).agg(F.sum(F.col("w") * F.col("si") * F.col("sj")).alias("w"))
        ).df
        field = keep(field.join(a, "i").groupBy(F.col("ri").alias("i")).agg(F.sum(F.col("w") * F.col("si")).alias("w"))).df
        moved = member.join(to.withColumnRenamed("rel", "step"), "meta").select("orig", F.col("rep").alias("meta"), (F.col("rel") * F.col("step")).cast("int").alias("rel"))
        kept = keep(moved, metas=F.approx_count_distinct("meta"))
        member = kept.df
        if kept.stats["metas"] <= 1:
            break
    last = ascend(start(config.seed ^ (config.rounds * 1000), 1), weights, field, 3 * config.sweeps)
    signs = member.join(last.select("meta", "sign"), "meta").select(F.col("orig").alias("meta"), (F.col("rel") * F.col("sign")).alias("sign"))
    return propagate(write_back(pairs.df, signs, locked), alts)
