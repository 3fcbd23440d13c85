"""Mixing sources to target weights: exact block quotas, split over output shards by a multivariate-hypergeometric tree."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sojourn.session import cut

#: Vocabulary of a public tokenizer; every executor must see the path.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how that public family of tokenizers splits a text before merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> tiktoken.Encoding:
    """The tokenizer of a vocabulary file, once per Python worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def source_name(name: Column) -> Column:
    """One spelling of a source: lower case, trimmed, words joined by underscores."""
    return F.regexp_replace(F.lower(F.trim(name)), r"(?U)[\s_-]+", "_")


def count_tokens(df: DataFrame, text: str, columns: list[str], path: str = VOCABULARY) -> DataFrame:
    """``columns`` plus ``tokens`` of the whole text; null and empty texts have 0."""
    slim = df.select(*columns, text)
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns) + ", tokens long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(path).encode_ordinary
        for batch in batches:
            yield batch[columns].assign(tokens=[len(encode(t)) if isinstance(t, str) else 0 for t in batch[text]])

    return slim.mapInPandas(run, schema)


def split_tree(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """``shards x sources``: how many blocks of each source go to each shard.

    Halve the shards, draw the left half's blocks from all without replacement (multivariate hypergeometric), go on in
    both halves. Columns add up to ``counts`` exactly and shards differ by one block at most.
    """
    out = np.zeros((shards, len(counts)), np.int64)

    def divide(have: np.ndarray, first: int, last: int) -> None:
        if last - first == 1:
            out[first] = have
            return
        middle = (first + last) // 2
        share = int(have.sum()) * (middle - first) // (last - first)
        left = rng.multivariate_hypergeometric(have, share, method="marginals") if have.sum() else np.zeros_like(have)
        divide(left, first, middle)
        divide(have - left, middle, last)

    divide(np.asarray(counts, np.int64), 0, shards)
    return out


def plan(blocks: pd.DataFrame, targets: pd.DataFrame, shards: int, seed: int) -> pd.DataFrame:
    """``(source, block, copy, shard, upto)`` from ``(source, block, tokens)`` and the targets.

    The mixture is as large as the scarcest source allows: its tokens times its repeats over its share. Each source's
    quota is filled by passes over its blocks in a new order each; a pass takes a block once, so no document comes
    more often than ``max_repeats``. The block at the end is taken only up to ``upto`` tokens (else null). Targets of
    sources without tokens can't be reached; the others share what is left in proportion.
    """
    rng = np.random.default_rng(seed)
    have = blocks.groupby("source")["tokens"].sum()
    targets = targets[(targets["target_share"] > 0) & (targets["max_repeats"] > 0)]
    open_ = targets[targets["source"].isin(have[have > 0].index)].sort_values("source")
    columns = ["source", "block", "copy", "shard", "upto"]
    if not len(open_):
        return pd.DataFrame({c: pd.Series(dtype="object") for c in columns})
    weight = open_["target_share"] / open_["target_share"].sum()
    total = min(have[s] * r / w for s, r, w in zip(open_["source"], open_["max_repeats"], weight, strict=True))
    chosen, counts = [], []
    for source, w in zip(open_["source"], weight, strict=True):
        own = blocks[blocks["source"] == source].sort_values("block")
        left, rows, copy = int(round(total * w)), [], 0
        while left > 0:
            copy += 1
            for k in rng.permutation(len(own)):
                block, size = int(own["block"].iloc[k]), int(own["tokens"].iloc[k])
                if left <= 0:
                    break
                rows.append((source, block, copy, None if size <= left else left))
                left -= size
        chosen.append([rows[k] for k in rng.permutation(len(rows))])
        counts.append(len(rows))
    tree = split_tree(np.array(counts), shards, rng)
    out = []
    for k, rows in enumerate(chosen):
        ends = np.cumsum(tree[:, k])
        out += [(*row[:3], int(np.searchsorted(ends, i, side="right")), row[3]) for i, row in enumerate(rows)]
    return pd.DataFrame(out, columns=columns)


def mix(documents: DataFrame, targets: DataFrame, shard_tokens: int = 20_000_000, block_tokens: int = 200_000, most_blocks: int = 4096, seed: int = 17, path: str = VOCABULARY, least_shards: int = 32) -> DataFrame:
    """``(doc_id, source, copy, shard, position, tokens)``: the mixed corpus, by output shard.

    Sources are compared by :func:`source_name`. Texts fetched again under a new id (told by a 256-bit digest) are one
    document (the one of the smallest id), so that none is used more than ``max_repeats`` times; null sources, empty texts and sources without
    a target are not used. Each source's documents fall into blocks of about ``block_tokens`` (64 to ``most_blocks`` a
    source) by a hash; only the blocks' token totals, at most sources times ``most_blocks`` numbers, reach the driver,
    and as many assignments per pass are joined back. There are as many shards as hold about ``shard_tokens`` each, so
    that ordering a shard (ids alone) stays a small task, and ``least_shards`` at least, so that the tree deals the
    blocks whatever the corpus' size. ``position`` is a random order within the shard. The same
    input and seed give the same mixture.
    """
    spark = documents.sparkSession
    goals = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    wanted = documents.select("doc_id", source_name(F.col("source")).alias("source"), "text", F.unhex(F.sha2("text", 256)).alias("h")).join(goals.select("source"), "source", "left_semi").filter("text is not null and text <> ''")
    # Texts are counted where they lie; only ids, sizes and fingerprints are shuffled to find texts fetched again.
    counted = count_tokens(wanted, "text", ["doc_id", "source", "h"], path).filter("tokens > 0")
    sized = cut(counted.groupBy("source", "h").agg(F.min("doc_id").alias("doc_id"), F.min("tokens").alias("tokens")).drop("h"))
    per_source = {r["source"]: r["tokens"] for r in sized.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    blocks = F.lit(64)
    for source, tokens in per_source.items():
        blocks = F.when(F.col("source") == source, min(most_blocks, max(64, tokens // block_tokens))).otherwise(blocks)
    shards = max(1, least_shards, -(-sum(per_source.values()) // shard_tokens))
    sized = sized.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), blocks).cast("int"))
    totals = sized.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")).toPandas()
    rows = plan(totals, goals.toPandas(), shards, seed)
    schema = "source string, block int, copy int, shard int, upto long"
    assigned = spark.createDataFrame([tuple(None if pd.isna(v) else v if isinstance(v, str) else int(v) for v in r) for r in rows.itertuples(index=False)], schema)
    # Sources x blocks x passes rows of five small values, whatever the corpus; it is broadcast only up to a million.
    drawn = sized.join(F.broadcast(assigned) if len(rows) <= 1_000_000 else assigned, ["source", "block"]).withColumn("order", F.xxhash64("doc_id", "copy", F.lit(seed + 1)))
    whole = drawn.filter("upto is null")
    partial = drawn.filter("upto is not null")
    running = F.sum("tokens").over(Window.partitionBy("source", "block", "copy").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    partial = partial.withColumn("running", running).filter(F.col("running") <= F.col("upto")).drop("running")
    out = whole.unionByName(partial)
    within = F.row_number().over(Window.partitionBy("shard").orderBy("order", "doc_id", "copy"))
    return out.withColumn("position", within).select("doc_id", "source", "copy", "shard", "position", "tokens")


def mix_report(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, target_share, max_repeats, reached_share, tokens, documents, most_used)`` of every target."""
    goals = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    used = mixture.groupBy("source", "doc_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("times")).groupBy("source").agg(F.sum("t").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("times").alias("most_used"))
    joined = goals.join(used, "source", "left").fillna(0, ["tokens", "documents", "most_used"])
    total = joined.agg(F.sum("tokens").alias("total"))
    return joined.withColumn("reached_share", F.try_divide(F.col("tokens"), total.scalar())).select("source", "target_share", "max_repeats", "reached_share", "tokens", "documents", "most_used")
