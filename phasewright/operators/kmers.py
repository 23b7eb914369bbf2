"""K-mers of node sequences: windows, sketches, similarity and parental scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasewright.functions import kmers as K


def _per_sequence(nodes: DataFrame, values: Callable[[str], np.ndarray], name: str) -> DataFrame:
    """(node_id, name) with the array of values of each sequence; null sequences are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [K.signed(values(s or "")) for s in batch.column("seq").to_pylist()]
            at = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
            flat = np.concatenate(lists) if lists else np.empty(0, np.int64)
            column = pa.ListArray.from_arrays(pa.array(at), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("node_id"), column], names=["node_id", name])

    return nodes.select(F.col("node_id").cast("long").alias("node_id"), "seq").mapInArrow(run, f"node_id long, {name} array<long>")


def canonical_kmers(nodes: DataFrame, k: int = 16) -> DataFrame:
    """(node_id, kmers): the canonical code of every window of k bases, in order; ambiguous bases end a window."""
    return _per_sequence(nodes, lambda s: K.canonical(s, k), "kmers")


def sketches(nodes: DataFrame, k: int = 16, size: int = 1000) -> DataFrame:
    """(node_id, hashes): bottom-``size`` sketch in unsigned order as signed numbers; short sequences give an empty one."""
    return _per_sequence(nodes, lambda s: K.sketch(s, k, size), "hashes")


def similarities(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the multiset Jaccard similarity of their sketches; 0 where one is empty or missing.

    Each distinct pair meets its two sketches by joins, and batches of pairs
    intersect them as sorted arrays; nothing is exploded.
    """
    of = lambda side: sketch.select(F.col("node_id").alias(side), F.col("hashes").alias(f"h{side}"))
    none = F.array().cast("array<bigint>")
    both = pairs.select("a", "b").distinct().join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", *[F.coalesce(h, none).alias(h) for h in ("ha", "hb")])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            row, values = [], []
            for name in ("ha", "hb"):
                lists = batch.column(name)
                row.append(np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy())))
                values.append(lists.flatten().to_numpy())
            own, place, = np.unique(np.concatenate(values), return_inverse=True)
            # hashes of both sides by (pair, hash), with how often each side has them
            key = np.concatenate(row) * np.int64(max(len(own), 1)) + place
            (ka, na), (kb, nb) = (np.unique(k, return_counts=True) for k in (key[: len(row[0])], key[len(row[0]) :]))
            common, x, y = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
            shared = np.bincount(common // max(len(own), 1), weights=np.minimum(na[x], nb[y]), minlength=n)
            size = [np.bincount(r, minlength=n) for r in row]
            filled = (size[0] > 0) & (size[1] > 0)
            jaccard = np.where(filled, shared / np.maximum(size[0] + size[1] - shared, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(jaccard)], names=["a", "b", "jaccard"])

    return both.mapInArrow(meet, "a long, b long, jaccard double")


def kmer_set(sequences: DataFrame, k: int = 31) -> DataFrame:
    """(h): the distinct hashes of a parent's k-mers, each the smaller hash of both strands."""
    return _hashed(sequences.select(F.lit(0).alias("node_id"), "seq"), k).select("h").distinct()


def _hashed(nodes: DataFrame, k: int) -> DataFrame:
    """(node_id, h, m): the different hashes of each node's k-mers and how often each comes; a node is one row, so nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, seq in zip(batch.column("node_id").to_pylist(), batch.column("seq").to_pylist(), strict=True):
                _, forward, reverse = K.codes(seq or "", k)
                h, m = np.unique(np.minimum(K.invertible(forward, k), K.invertible(reverse, k)), return_counts=True)
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), node), pa.int64()), pa.array(K.signed(h), pa.int64()), pa.array(m, pa.int64())], names=["node_id", "h", "m"])

    return nodes.select(F.col("node_id").cast("long").alias("node_id"), "seq").mapInArrow(_joined(run), "node_id long, h long, m long")


def _joined(run: Callable, rows: int = 20_000) -> Callable:
    """``run`` with its small batches put together."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in run(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return work


def trio_scores(nodes: DataFrame, paternal: DataFrame, maternal: DataFrame, k: int = 31) -> DataFrame:
    """(node_id, pat_count, mat_count): windows of each node that are among a parent's k-mers, repeats counted.

    Windows are counted per node and hash where they are made, and shuffled
    once, to the parents' hashes; nodes without a match, or without a
    sequence, have zeros.
    """
    rows = _hashed(nodes, k)
    tagged = paternal.select("h", F.lit(1).alias("pat"), F.lit(0).alias("mat")).unionByName(maternal.select("h", F.lit(0).alias("pat"), F.lit(1).alias("mat")))
    parents = tagged.groupBy("h").agg(F.max("pat").alias("pat"), F.max("mat").alias("mat"))
    hit = rows.join(parents, "h").groupBy("node_id").agg(F.sum(F.col("m") * F.col("pat")).alias("pat_count"), F.sum(F.col("m") * F.col("mat")).alias("mat_count"))
    return nodes.select("node_id").join(hit, "node_id", "left").select("node_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("pat_count", "mat_count")])


PATERNAL, MATERNAL, SCORED = 1, 2, 4
#: Bases, or windows, that are worked on at once.
AT_ONCE = 1 << 19
MINIMIZER = 11


def sequence_scores(nodes: DataFrame, marked: DataFrame, k: int = 31) -> DataFrame:
    """(node_id, pat_count, mat_count) as ``trio_scores``, from sequences instead of sets of k-mers.

    ``marked``: node_id, seq, mark; each sequence is read once.  The bits of
    mark say what it is: ``PATERNAL`` and ``MATERNAL`` that its k-mers are a
    parent's, ``SCORED`` that its windows count for its node.  Instead of a row
    a k-mer, the runs of windows with an equal minimizer are shuffled, packed
    at two bits a base and put together by minimizer class, of which there are
    16 for each shuffle partition; a class has all that its k-mers meet.
    """
    classes = 16 * int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = marked.select(F.coalesce(F.col("node_id").cast("long"), F.lit(0)).alias("node_id"), F.coalesce("seq", F.lit("")).alias("seq"), F.when(F.col("node_id").isNull(), F.col("mark").bitwiseAND(PATERNAL | MATERNAL)).otherwise(F.col("mark")).cast("int").alias("mark"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _classed(batch, k, classes)

    def meet(table: pa.Table) -> pa.Table:
        return _met(table, k)

    pieces = one.where(F.col("mark") > 0).where(F.length("seq") >= k).mapInArrow(cut, "class int, nodes array<long>, runs array<long>, bases binary")
    hit = pieces.groupBy("class").applyInArrow(meet, "node_id long, pat_count long, mat_count long").groupBy("node_id").agg(F.sum("pat_count").alias("pat_count"), F.sum("mat_count").alias("mat_count"))
    return nodes.select("node_id").join(hit, "node_id", "left").select("node_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("pat_count", "mat_count")])


def _classed(batch: pa.RecordBatch, k: int, classes: int) -> Iterator[pa.RecordBatch]:
    """Rows (class, nodes, runs, bases) of a batch of (node_id, seq, mark): the runs of a class, with 8 x windows + mark of each, and their bases."""
    seqs = [s.encode() for s in batch.column("seq").to_pylist()]
    data = np.frombuffer(b"".join(seqs), np.uint8)  # letters of more than one byte are ambiguous in each
    ends = np.cumsum([len(s) for s in seqs])
    node, mark = batch.column("node_id").to_numpy(), batch.column("mark").to_numpy().astype(np.int64)
    for at in range(0, len(data), AT_ONCE):
        base = K.bases(data[at : at + AT_ONCE + k - 1])
        owner = np.searchsorted(ends, np.arange(at, at + len(base)), side="right")
        start, windows, low = K.runs(base, owner, k, min(k, MINIMIZER))
        if not len(start):
            continue
        of = (low % np.uint64(classes)).astype(np.int32)
        order = np.argsort(of, kind="stable")
        start, windows, of = start[order], windows[order], of[order]
        own, length = owner[start], windows + k - 1
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        edges = np.append(first, len(of)).astype(np.int32)
        edge_bytes = np.concatenate(([0], np.cumsum((length + 3) // 4)))[edges].astype(np.int32)
        rows = lambda x: pa.ListArray.from_arrays(pa.array(edges), pa.array(x, pa.int64()))  # noqa: B023, E731
        bases = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(edge_bytes), pa.py_buffer(K.packed(base, start, length))])
        yield pa.RecordBatch.from_arrays([pa.array(of[first]), rows(node[own]), rows(8 * windows + mark[own]), bases], names=["class", "nodes", "runs", "bases"])


def _met(table: pa.Table, k: int) -> pa.Table:
    """(node_id, pat_count, mat_count) of one class, from its parents' k-mers; the runs are unpacked part by part."""
    node, runs = (pa.concat_arrays([c.flatten() for c in table.column(x).chunks]).to_numpy() for x in ("nodes", "runs"))
    windows, mark = runs >> 3, runs & 7
    ends = np.cumsum((windows + k + 2) // 4)
    data = np.frombuffer(b"".join(table.column("bases").to_pylist()), np.uint8)
    parts = np.flatnonzero(np.diff(np.concatenate(([-1], (np.cumsum(windows) - 1) // AT_ONCE))))

    def part(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """The k-mers of the runs from i to j, and the run of each."""
        begin = ends[i - 1] if i else 0
        codes = np.minimum(*K.window_codes(K.unpacked(data[begin : ends[j - 1]]), k))
        w = windows[i:j]
        own = np.repeat(np.arange(i, j), w)
        first = 4 * (np.concatenate(([begin], ends[i : j - 1])) - begin)
        return codes[np.repeat(first - np.cumsum(w) + w, w) + np.arange(len(own))], own

    spans = list(zip(parts, [*parts[1:], len(runs)], strict=True))
    held = [part(*spans[0])] if len(spans) == 1 else None
    each = lambda: held or (part(i, j) for i, j in spans)
    sets: list[list[np.ndarray]] = [[], []]
    for codes, own in each():
        for found, bit in zip(sets, (PATERNAL, MATERNAL), strict=True):
            found.append(np.unique(codes[mark[own] & bit > 0]))
    pat, mat = (np.unique(np.concatenate(x)) if len(x) > 1 else x[0] for x in sets)
    known = np.union1d(pat, mat)
    counts = np.zeros((2, len(runs)), np.int64)
    if len(known):
        among = np.stack([np.isin(known, x, assume_unique=True) for x in (pat, mat)])
        for codes, own in each():
            scored = mark[own] & SCORED > 0
            codes, own = codes[scored], own[scored]
            at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
            same = known[at] == codes
            counts += [np.bincount(own[same & x[at]], minlength=len(runs)) for x in among]
    some = counts.any(axis=0)
    ids, place = np.unique(node[some], return_inverse=True)
    total = [np.bincount(place, weights=c[some], minlength=len(ids)).astype(np.int64) for c in counts]
    return pa.table({"node_id": pa.array(ids, pa.int64()), "pat_count": total[0], "mat_count": total[1]})


def trio_locks(scores: DataFrame, phasing: DataFrame, lock_ratio: float = 0.8, min_total: int = 1) -> DataFrame:
    """(node_id, phase) of the phasing nodes that one parent's k-mers dominate: 0 paternal, else 1 maternal."""
    total = F.col("pat_count") + F.col("mat_count")
    share = lambda c: F.col(c) / F.when(total > 0, total)
    phase = F.when(share("pat_count") >= lock_ratio, 0).when(share("mat_count") >= lock_ratio, 1)
    return scores.join(phasing.select("node_id").distinct(), "node_id", "left_semi").where(total >= min_total).select("node_id", phase.cast("byte").alias("phase")).where("phase IS NOT NULL")
