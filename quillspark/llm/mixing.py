"""A training mix with target shares per source.

Method: the tokens of each source are packed into blocks of one length; each output shard draws how many of its slots go
to each source, slots are mapped to blocks through pseudorandom permutations of the source's block numbers, and blocks
are joined by number.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, takewhile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import broadcast_if_small, cut

#: Tokens of a block; slots of a shard.
BLOCK, SHARD = 1024, 512
#: Letters of a bucket: a source's stream is cut into buckets of about so many, each packed by itself in one task.
BUCKET = 1_000_000
#: Fixed value: what splits text before byte pairs are merged, for byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

_encoders: dict[str, object] = {}


def encoder(path: str):
    """The byte-pair encoder of a public vocabulary file (lines of base64 token and rank); once per Python worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def packed(docs: DataFrame, doc_id: str, source: str, text: str, vocabulary: str, block: int = BLOCK, seed: int = 1, bucket: int = BUCKET) -> DataFrame:
    """``source, bucket, local, tokens, doc_ids``: the blocks of every source, numbered from 0 within a bucket, of the
    documents with a source and a text.

    A document's bucket and its place in it follow from a hash of its id and the seed, so the blocks are the same however
    the rows are split over files and tasks. Texts are shuffled once, by source and bucket; a source of any size has buckets
    of one size. The last block of a bucket may be shorter."""
    kind = docs.schema[doc_id].dataType.simpleString()
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("x")).where((F.length("x") > 0) & (F.length("source") > 0))
    sizes = src.groupBy("source").agg(F.ceil(F.sum(F.length("x")) / bucket).alias("buckets"))
    src = src.join(broadcast_if_small(cut(sizes, "sizes")), "source").withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("bucket", F.pmod(F.xxhash64("h"), F.col("buckets")))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = src.repartition(tasks, "source", "bucket").sortWithinPartitions("source", "bucket", "h", "doc_id", F.xxhash64("x"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, out = encoder(vocabulary), []
        at, local, tokens, spans = None, 0, [], []  # of the open bucket: blocks so far, tokens left, and the documents they are of

        def fill(least: int) -> None:
            nonlocal local, tokens, spans
            p = k = 0
            while len(tokens) - p >= least and p < len(tokens):
                while spans[k][2] <= p:
                    k += 1
                inside = dict.fromkeys(x[0] for x in takewhile(lambda x: x[1] < p + block, islice(spans, k, None)))
                out.append((*at, local, tokens[p : p + block], list(inside)))
                local, p = local + 1, p + block
            tokens, spans = tokens[p:], [(d, max(0, start - p), end - p) for d, start, end in spans if end > p]

        for b in batches:
            for d, s, k, t in zip(b["doc_id"], b["source"], b["bucket"], enc.encode_ordinary_batch(b["x"].tolist(), num_threads=1)):
                if (s, k) != at:
                    if at:
                        fill(1)
                    at, local, tokens, spans = (s, k), 0, [], []
                if t:
                    spans.append((d, len(tokens), len(tokens) + len(t)))
                    tokens += t
                    if len(tokens) >= block:
                        fill(block)
            if len(out) > 500:
                yield _frame(out)
                out = []
        if at:
            fill(1)
        yield _frame(out)

    return src.select("doc_id", "source", "bucket", "x").mapInPandas(pack, f"source string, bucket long, local long, tokens array<int>, doc_ids array<{kind}>")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["source", "bucket", "local", "tokens", "doc_ids"]).astype({"bucket": "int64", "local": "int64"}) if rows else pd.DataFrame({"source": pd.Series([], dtype=object), "bucket": pd.Series([], dtype="int64"), "local": pd.Series([], dtype="int64"), "tokens": pd.Series([], dtype=object), "doc_ids": pd.Series([], dtype=object)})


def _firsts(blocks: DataFrame, group: int = 1024) -> DataFrame:
    """``source, bucket, first``: the number of the first block of each bucket in its source. Sums run within groups of
    buckets and over the groups, so no task has all buckets of a source."""
    n = cut(blocks.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("g", F.floor(F.col("bucket") / group)), "buckets")
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    groups = n.groupBy("source", "g").agg(F.sum("n").alias("n")).select("source", "g", F.coalesce(F.sum("n").over(before("source", "g")), F.lit(0)).alias("base"))
    inner = n.select("source", "bucket", "g", F.coalesce(F.sum("n").over(before("source", "g", "bucket")), F.lit(0)).alias("own"))
    return inner.join(broadcast_if_small(groups), ["source", "g"]).select("source", "bucket", (F.col("base") + F.col("own")).alias("first"))


@dataclass(frozen=True)
class Plan:
    """What the mix takes: per source its blocks, slots and target share; the total of slots; the source that sets the
    default total, as it reaches its repeats first."""

    sources: tuple[str, ...]
    blocks: tuple[int, ...]
    slots: tuple[int, ...]
    targets: tuple[float, ...]
    binding: str | None = None

    @property
    def total(self) -> int:
        return sum(self.slots)


def plan_mix(blocks: dict[str, int], targets: dict[str, tuple[float, int]], total_blocks: int | None = None) -> Plan:
    """Slots per source with ``blocks`` blocks. Sources without blocks, share or permission to appear give nothing; the shares of the others
    are scaled to 1. The default total is the greatest at which each of them can have its share without appearing more
    often than allowed; with a greater ``total_blocks`` the sources that run out stop there, and the rest is shared by
    the others as far as they reach."""
    have = {s: blocks[s] for s, (share, most) in targets.items() if blocks.get(s, 0) > 0 and share > 0 and most > 0}
    names = sorted(have)
    room = np.array([have[s] * targets[s][1] for s in names], np.int64)
    share = np.array([targets[s][0] for s in names], float)
    if not names:
        return Plan((), (), (), ())
    share /= share.sum()
    want = int((room / share).min()) if total_blocks is None else min(total_blocks, int(room.sum()))
    slots = np.zeros(len(names), np.int64)
    while (left := want - int(slots.sum())) > 0:
        open_ = slots < room
        give = np.where(open_, share, 0.0)
        exact = give / give.sum() * left
        step = np.minimum(np.floor(exact).astype(np.int64), room - slots)
        if not step.sum():  # the last few slots by largest remainder
            for k in np.argsort(-(exact - np.floor(exact)) * open_, kind="stable")[:left]:
                step[k] = int(open_[k])
        slots += step
        if not step.sum():
            break
    return Plan(tuple(names), tuple(have[s] for s in names), tuple(int(x) for x in slots), tuple(float(x) for x in share), names[int((room / share).argmin())] if total_blocks is None else None)


def draw(slots: np.ndarray, total: int, shard: int, number: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each source in shard ``number`` and in all shards before it, of ``slots`` per source and ``total`` in all.

    The shards are halved again and again; each half draws its share of the slots by a multinomial of what its parent has
    of each source, from a seed of its own, and the other half has the rest. So every task finds the draw of any shard by
    itself, all agree, and the totals are exact. What a draw takes beyond a source's slots goes to those with most left."""
    lo, hi = 0, -(-total // shard)
    have, before = np.asarray(slots, np.int64), np.zeros(len(slots), np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        size = (mid - lo) * shard
        drawn = np.minimum(np.random.default_rng([seed, lo, hi]).multinomial(size, have / have.sum()), have)
        while (short := size - int(drawn.sum())) > 0:
            k = int((have - drawn).argmax())
            drawn[k] += min(short, int(have[k] - drawn[k]))
        if number < mid:
            hi, have = mid, drawn
        else:
            lo, have, before = mid, have - drawn, before + drawn
    return have, before


def permuted(n: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of ``n`` in a pseudorandom permutation of 0..size-1 that depends on ``key``: four Feistel rounds over the
    next even number of bits, walked until the value falls below ``size``."""
    n, size, key = (np.asarray(x, np.uint64) for x in (n, size, key))
    half = np.array([max(1, (int(s - 1).bit_length() + 1) // 2) if s > 1 else 1 for s in size.tolist()], np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)

    def once(v: np.ndarray) -> np.ndarray:
        a, b = v >> half, v & mask
        for r in range(4):
            x = b + key + np.uint64(r + 1) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            a, b = b, a ^ ((x ^ (x >> np.uint64(31))) & mask)
        return a << half | b

    with np.errstate(over="ignore"):
        out = once(n)
        while (out >= size).any():
            out = np.where(out >= size, once(out), out)
    return out.astype(np.int64)


def _slots(spark, plan: Plan, shard: int, seed: int) -> DataFrame:
    """``source, block, shard, slot, repeat``: one row per slot. Shards are numbers; tasks draw and fill them by themselves."""

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots = np.array(plan.slots, np.int64)
        for b in batches:
            for j in b["id"].tolist():
                drawn, before = draw(slots, plan.total, shard, j, seed)
                k = np.repeat(np.arange(len(drawn)), drawn)
                number = before[k] + np.arange(len(k)) - (np.cumsum(drawn) - drawn)[k]
                blocks = np.array(plan.blocks, np.int64)[k]
                repeat = number // blocks
                with np.errstate(over="ignore"):
                    key = np.full(len(k), seed, np.uint64) * np.uint64(1_000_003) + k.astype(np.uint64) * np.uint64(8191) + repeat.astype(np.uint64)
                # within a shard the sources are shuffled
                slot = np.random.default_rng([seed, j]).permutation(len(k)).astype(np.int64)
                yield pd.DataFrame({"source": np.array(plan.sources, object)[k], "block": permuted(number % blocks, blocks, key), "shard": np.full(len(k), j, np.int64), "slot": slot, "repeat": repeat.astype(np.int32)})

    return spark.range(-(-plan.total // shard)).mapInPandas(fill, "source string, block long, shard long, slot long, repeat int")


def mix(docs: DataFrame, targets: DataFrame, vocabulary: str, doc_id: str = "doc_id", source: str = "source", text: str = "text", block: int = BLOCK, shard: int = SHARD, seed: int = 1, total_blocks: int | None = None) -> DataFrame:
    """The mix, a row per slot: ``shard, slot, source, block, repeat, tokens, doc_ids``.

    ``targets`` has ``source, target_share, max_repeats``. ``tokens`` is the block's part of the source's stream (the
    last block of a bucket may be shorter), ``doc_ids`` the documents it has parts of, ``repeat`` counts from 0 how often
    the block came before. A block comes once in each pass over its source and there are at most max_repeats passes, so
    no document appears more often. Shares are those of the slots, exact but for rounding to blocks.

    Documents without source, text or tokens, and sources without a target, are in no mix; targets whose source has no
    documents leave their share to the others. A source stated twice counts with its greatest share. Empty tables give an
    empty mix. Repeated doc_ids are documents of their own.

    The same rows, seed and vocabulary give the same mix, however the rows are split over files and tasks. Rows that
    repeat an id with another text are ordered by a hash of the text.

    Plan: texts are shuffled once by source and bucket, encoded and packed there, and the blocks written as a table. Slots
    are made in tasks, from the shard's number; the driver holds one number per source. Blocks meet their slots by index:
    the slots are broadcast if they are few, else both sides are shuffled by source and block.
    """
    return mix_and_supply(docs, targets, vocabulary, doc_id, source, text, block, shard, seed, total_blocks)[0]


def mix_and_supply(docs: DataFrame, targets: DataFrame, vocabulary: str, doc_id: str = "doc_id", source: str = "source", text: str = "text", block: int = BLOCK, shard: int = SHARD, seed: int = 1, total_blocks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The ``mix``, and of each source with tokens and a target ``source, supply, binding``: the tokens of its documents, each
    counted once, and whether it is the one that sets the default total."""
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    out = f"shard long, slot long, source string, block long, repeat int, tokens array<int>, doc_ids array<{kind}>"
    wanted = targets.groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).collect()
    want = {r.source: (r.t.target_share or 0.0, r.t.max_repeats or 0) for r in wanted if r.source}
    known = broadcast_if_small(spark.createDataFrame([(s,) for s in want], "s_ string"))
    blocks = cut(packed(docs.join(known, F.col(source) == F.col("s_"), "left_semi"), doc_id, source, text, vocabulary, block, seed), "blocks")
    sums = blocks.groupBy("source").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.size("tokens").cast("long")).alias("tokens")).collect()
    plan = plan_mix({r.source: r.blocks for r in sums}, want, total_blocks)
    supply = spark.createDataFrame([(r.source, r.tokens, r.source == plan.binding) for r in sums], "source string, supply long, binding boolean")
    if not plan.total:
        return spark.createDataFrame([], out), supply
    numbered = blocks.join(broadcast_if_small(cut(_firsts(blocks), "firsts")), ["source", "bucket"])
    numbered = numbered.select("source", (F.col("first") + F.col("local")).alias("block"), "tokens", "doc_ids")
    slots = broadcast_if_small(_slots(spark, plan, shard, seed))
    return numbered.join(slots, ["source", "block"]).select("shard", "slot", "source", "block", "repeat", "tokens", "doc_ids"), supply


def shares(mixed: DataFrame, targets: DataFrame, supply: DataFrame | None = None) -> DataFrame:
    """Per source of ``targets``: ``source, target_share, tokens, blocks, passes, share`` reached (0 where it gave nothing). With
    the ``supply`` of ``mix_and_supply`` also ``supply``, ``left_out`` (tokens of it that no slot holds) and ``binding``."""
    got = mixed.groupBy("source").agg(F.sum(F.when(F.col("repeat") == 0, F.size("tokens").cast("long"))).alias("once"), F.sum(F.size("tokens").cast("long")).alias("tokens"), F.count(F.lit(1)).alias("blocks"), (F.max("repeat") + 1).alias("passes"))
    all_ = got.agg(F.sum("tokens").alias("all_tokens"))
    out = targets.groupBy("source").agg(F.max("target_share").alias("target_share")).join(got, "source", "left").crossJoin(F.broadcast(all_))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    cols = ["source", "target_share", zero("tokens"), zero("blocks"), zero("passes"), F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("share")]
    if supply is None:
        return out.select(*cols)
    # every block that a source gives comes in its first pass
    left = (F.coalesce("supply", F.lit(0)) - F.coalesce("once", F.lit(0))).alias("left_out")
    return out.join(supply, "source", "left").select(*cols, zero("supply"), left, F.coalesce("binding", F.lit(False)).alias("binding"))
