"""Mixing sources to target weights, measured in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasewright.plans.tables import keep

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: How the vocabulary's public tokenizer cuts a text before merging (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEED = "mix"
#: A text is cut for the tokenizer into pieces of about this many characters, at white space.
PIECE = 100_000


@functools.cache
def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces that end before a white space after a letter, where the tokenizer cuts as well."""
    start = 0
    while len(text) - start > PIECE:
        end = start + PIECE
        while end < len(text) and not (text[end] == " " and text[end - 1].isalpha()):
            end += 1
        yield text[start:end]
        start = end
    yield text[start:]


def count_tokens(texts: DataFrame, text: str = "text", path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """``texts`` with the column ``text`` replaced by ``tokens``, the whole text's length in tokens; 0 for a null or empty text.

    ``path`` is a vocabulary file of ranks that every executor can read.  The
    text itself leaves the plan here; nothing is shuffled.
    """
    kept = [c for c in texts.columns if c != text]
    fields = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoding(path)
        for batch in batches:
            sizes = [sum(len(own.encode_ordinary(p)) for p in _pieces(t)) if t else 0 for t in batch.column(text).to_pylist()]
            rest = batch.select(kept)
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(sizes, pa.int64())], names=[*kept, "tokens"])

    return texts.select(*kept, text).mapInArrow(run, f"{fields}{', ' if fields else ''}tokens long")


def source_label(source: Column) -> Column:
    """A source's name in one spelling: lower case, no white space around it, ``_`` for blanks and hyphens within."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s\-]+", "_")


def chance(seed: str, key: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the key only."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def repetition_rates(available: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """How often each source is to be repeated: source, target_share, wanted_share, max_repeats, available, rate.

    ``available`` has source and tokens (one row per source), ``targets`` has
    source, target_share and max_repeats.  Targets of one source given more
    than once are added up, with the largest cap.  A source without tokens or
    with a share or cap that is null or not positive gets rate 0, and its
    share is divided among the others in proportion (``wanted_share``).

    Without ``total_tokens`` the total is the largest at which every source
    reaches its share within its cap.  With it, sources whose cap is too small
    are used up to the cap and the rest is divided among the others in
    proportion to their shares, as far as their caps go.
    """
    want = targets.where("source IS NOT NULL").groupBy(source_label(F.col("source")).alias("source")).agg(
        F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")
    )
    both = want.join(available.select("source", F.col("tokens").alias("available")), "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    usable = (F.col("available") > 0) & (F.coalesce("target_share", F.lit(0.0)) > 0) & (F.coalesce("max_repeats", F.lit(0)) > 0)
    both = both.withColumn("share", F.when(usable, F.col("target_share")).otherwise(0.0))
    # the total at which a source of share s and room r (tokens times cap) is used up: t = r / s
    both = both.withColumn("room", F.when(F.col("share") > 0, F.col("available") * F.col("max_repeats")).cast("double"))
    both = both.withColumn("full_at", F.col("room") / F.when(F.col("share") > 0, F.col("share")))
    every = Window.partitionBy(F.lit(0))  # one row per source of the target table
    if total_tokens is None:
        level = F.min("full_at").over(every)
    else:
        order = every.orderBy(F.col("full_at").asc_nulls_last(), "source")
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        used = F.coalesce(F.sum("room").over(before), F.lit(0.0))
        share_left = F.greatest(F.sum("share").over(every) - F.coalesce(F.sum("share").over(before), F.lit(0.0)), F.lit(0.0))
        both = both.withColumn("try", (F.lit(float(total_tokens)) - used) / F.when(share_left > 1e-12, share_left))
        level = F.coalesce(F.min(F.when(F.col("try") <= F.col("full_at"), F.col("try"))).over(every), F.max("full_at").over(every))
    rate = F.least(level * F.col("share") / F.when(F.col("available") > 0, F.col("available")), F.col("max_repeats").cast("double"))
    return both.withColumn("rate", F.when(F.col("share") > 0, rate).otherwise(0.0)).withColumn("wanted_share", F.when(F.col("share") > 0, F.col("share") / F.sum("share").over(every)).otherwise(0.0)).select("source", "target_share", "wanted_share", "max_repeats", "available", "rate")


class Mixture:
    """``rates`` per source; ``copies``: doc, source, tokens, copies for every drawn document; ``shares``: what was reached."""

    def __init__(self, rates: DataFrame, copies: DataFrame, pages: DataFrame, draws: Column):
        self.rates, self.copies, self._pages, self._draws = rates, copies, pages, draws

    def emitted(self) -> DataFrame:
        """The mixture itself, one row per copy: doc, source, copy_no from 1, text.

        How often a document comes depends on its id and its source's rate
        alone, so the texts meet the rates (one row per source) and are not
        shuffled.
        """
        drawn = self._pages.where("text <> ''").join(self.rates.select("source", "rate"), "source").withColumn("copies", self._draws).where("copies > 0")
        return drawn.select("doc", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"), "text")

    def shares(self) -> DataFrame:
        """Per target source: its target and the share it was to have once sources without tokens gave theirs away, what was available, the rate, what was drawn, and the share reached."""
        per = self.copies.groupBy("source").agg(
            F.count(F.lit(1)).alias("docs"), F.sum("copies").cast("long").alias("copies"), F.sum(F.col("copies") * F.col("tokens")).cast("long").alias("drawn_tokens"),
            F.max("copies").alias("most_copies"),
        )
        zero = F.lit(0)
        out = self.rates.join(per, "source", "left").select(
            "source", "target_share", "wanted_share", "max_repeats", F.col("available").alias("available_tokens"), "rate",
            *[F.coalesce(c, zero).cast("long").alias(c) for c in ("docs", "copies", "drawn_tokens", "most_copies")],
        )
        total = F.sum("drawn_tokens").over(Window.partitionBy(F.lit(0)))
        return out.withColumn("actual_share", F.when(total > 0, F.col("drawn_tokens") / total).otherwise(0.0))


def mix_sources(
    documents: DataFrame, targets: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source",
    total_tokens: int | None = None, seed: str = SEED, path: str = f"{TOKENIZERS}/{VOCABULARY}",
) -> Mixture:
    """Draw documents so that the token sizes of the sources meet their target shares.

    Tokens are summed per source, giving each source its rate; each document
    is then drawn floor(rate) times and once more with a probability equal to
    the fraction, decided by a hash of the seed and its id.  A source's rate
    never exceeds its cap, so neither do the copies of a document.  Documents
    without tokens, without a source, or of a source that is no target are
    not drawn.  Repeated ids are documents of their own with the same fate.
    """
    pages = documents.select(F.col(doc).alias("doc"), source_label(F.col(source)).alias("source"), F.col(text).alias("text"))
    sized = keep(count_tokens(pages, "text", path)).df
    available = sized.where("source IS NOT NULL").groupBy("source").agg(F.sum("tokens").alias("tokens"))
    rates = keep(repetition_rates(available, targets, total_tokens)).df
    rate = F.col("rate")
    n = (F.floor(rate) + F.when(chance(seed, F.col("doc")) < rate - F.floor(rate), 1).otherwise(0)).cast("int")
    drawn = sized.join(rates.select("source", "rate"), "source").where("tokens > 0").select("doc", "source", "tokens", n.alias("copies"))
    return Mixture(rates, drawn.where("copies > 0"), pages, n)


def tokenizer_file(name: str = VOCABULARY, folder: str = TOKENIZERS) -> str:
    """Place of a vocabulary file; the folder is a parameter of the installation."""
    return os.path.join(folder, name)
