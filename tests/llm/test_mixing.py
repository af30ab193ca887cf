from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from quillspark.llm.mixing import _firsts, draw, encoder, mix, mix_and_supply, packed, permuted, plan_mix, shares

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
needs_vocabulary = pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="no public vocabulary here")


def test_permuted_is_a_permutation():
    for size in (1, 2, 3, 7, 64, 1000, 4097):
        for key in (0, 5, 2**63):
            p = permuted(np.arange(size), np.full(size, size), np.full(size, key, np.uint64))
            assert sorted(p) == list(range(size))
    assert list(permuted(np.arange(100), np.full(100, 100), np.full(100, 1))) != list(range(100))


def test_plan_exact_shares_and_caps():
    p = plan_mix({"a": 10_000, "b": 2_000, "c": 500, "gone": 0}, {"a": (0.5, 1), "b": (0.3, 2), "c": (0.1, 1), "gone": (0.1, 3), "x": (0.2, 0)})
    assert p.sources == ("a", "b", "c") and p.total == int(min(10_000 / (0.5 / 0.9), 4_000 / (0.3 / 0.9), 500 / (0.1 / 0.9)))
    for k, s in enumerate((0.5, 0.3, 0.1)):
        assert abs(p.slots[k] - p.total * s / 0.9) <= 1
    big = plan_mix({"a": 100, "b": 100}, {"a": (0.9, 1), "b": (0.1, 1)}, total_blocks=150)
    assert big.slots == (100, 50)
    assert plan_mix({}, {"a": (1.0, 1)}).total == 0


def test_draws_add_up():
    p = plan_mix({"a": 10_000, "b": 2_000}, {"a": (0.8, 1), "b": (0.2, 2)})
    d = [draw(np.array(p.slots), p.total, 64, j, 3) for j in range(-(-p.total // 64))]
    own, before = np.array([x for x, _ in d]), np.array([x for _, x in d])
    assert tuple(own.sum(axis=0)) == p.slots and (own.sum(axis=1)[:-1] == 64).all() and (own >= 0).all()
    assert (before == np.cumsum(own, axis=0) - own).all()
    assert 0.6 < own[:50, 0].sum() / own[:50].sum() < 0.95 and len({tuple(x) for x in own}) > 5


def test_many_shards_of_many_sources():
    slots = np.full(20_000, 10**9)  # more sources and slots than any list of draws could hold
    own, before = draw(slots, int(slots.sum()), 512, 30_000_000_000, 1)
    assert own.sum() == 512 and 0 <= before.min() and before.sum() == 512 * 30_000_000_000


@needs_vocabulary
def test_same_mix_however_rows_are_split(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], f"text {i} says {'more ' * (i % 37)}", i) for i in range(300)], "doc_id long, source string, text string, slot int")
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 2)], "source string, target_share double, max_repeats int")
    got = [sorted(map(str, mix(docs.repartition(n), targets, VOCABULARY, block=16, shard=8).collect())) for n in (3, 7)]
    assert got[0] == got[1] and len(got[0]) > 50


@needs_vocabulary
def test_buckets(spark):
    docs = spark.createDataFrame([(i, "a", f"text {i} says {'more ' * (i % 37)}") for i in range(200)] + [(7, "a", "again " * 5000)], "doc_id long, source string, text string")
    blocks = packed(docs, "doc_id", "source", "text", VOCABULARY, block=16, bucket=500)
    enc = encoder(VOCABULARY)
    rows = blocks.collect()
    assert Counter(t for r in rows for t in r.tokens) == Counter(t for r in docs.collect() for t in enc.encode_ordinary(r.text))
    of = {r.doc_id: enc.encode_ordinary(r.text) for r in docs.collect() if r.doc_id != 7}
    for r in rows:
        assert 0 < len(r.tokens) <= 16 and r.doc_ids
        if len(r.doc_ids) == 1 and r.doc_ids[0] != 7:
            assert str(r.tokens)[1:-1] in str(of[r.doc_ids[0]])
    whole = {d for d, t in of.items() if t}
    assert {d for r in rows for d in r.doc_ids} == whole | {7}
    numbers = [(f.first + r.local) for r in rows for f in [next(f for f in firsts if f.bucket == r.bucket)]] if (firsts := _firsts(blocks, group=3).collect()) else []
    assert sorted(numbers) == list(range(len(rows))) and len(firsts) > 20


@needs_vocabulary
def test_mix_whole(spark):
    rows = [(i, "a", f"alpha text number {i} " * (1 + i % 5), 0) for i in range(60)] + [(100 + i, "b", f"beta {i} ção " * 7, 0) for i in range(20)]
    rows += [(900, None, "none", 0), (901, "", "none", 0), (902, "b", "", 0), (903, "b", None, 0), (904, "zz", "no target", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, block int")
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 3), ("absent", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    out = mix(docs, targets, VOCABULARY, block=16, shard=8).collect()
    enc = encoder(VOCABULARY)
    texts = {r[0]: enc.encode_ordinary(r[2]) for r in rows if r[1] in ("a", "b") and r[2]}
    slots = Counter((r.shard, r.slot) for r in out)
    assert max(slots.values()) == 1
    assert sorted(s for j, s in slots if j == 0) == list(range(8))
    n = Counter(r.source for r in out)
    assert abs(n["a"] / len(out) - 2 / 3) < 0.05 and set(n) == {"a", "b"}
    times = Counter((r.source, r.block) for r in out)
    assert max(v for (s, _), v in times.items() if s == "a") == 1 and max(times.values()) <= 3
    for s in "ab":  # every block holds its part of the documents' tokens, and nothing twice
        blocks = {r.block: r for r in out if r.source == s}
        have = Counter(t for r in blocks.values() for t in r.tokens)
        whole = Counter(t for d, ts in texts.items() if (d < 100) == (s == "a") for t in ts)
        assert not have - whole
        if len(blocks) == -(-sum(whole.values()) // 16):
            assert have == whole
    full = [r for r in out if len(r.tokens) != 16]
    assert len(full) <= 4
    rep = {r.source: r for r in shares(spark.createDataFrame(out), targets).where("source IS NOT NULL").collect()}
    assert rep["absent"].share == 0 and abs(rep["a"].share + rep["b"].share - 1) < 1e-9


@needs_vocabulary
def test_empty(spark):
    docs = spark.createDataFrame([(1, "a", "x")], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mix(docs.limit(0), targets, VOCABULARY).count() == 0
    assert mix(docs, targets.limit(0), VOCABULARY).count() == 0
    assert mix(docs, targets, VOCABULARY).count() == 1


@needs_vocabulary
def test_left_out_and_binding(spark):
    rows = [(i, "a", f"alpha text number {i} " * 9) for i in range(60)] + [(100, "b", "beta " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixed, supply = mix_and_supply(docs, targets, VOCABULARY, block=16, shard=8)
    rep = {r.source: r for r in shares(mixed, targets, supply).collect()}
    enc = encoder(VOCABULARY)
    whole = {s: sum(len(enc.encode_ordinary(r[2])) for r in rows if r[1] == s) for s in "ab"}
    held = {s: sum({r.block: len(r.tokens) for r in mixed.collect() if r.source == s}.values()) for s in "ab"}
    assert {s: (rep[s].supply, rep[s].left_out, rep[s].binding) for s in rep} == {"a": (whole["a"], whole["a"] - held["a"], False), "b": (whole["b"], whole["b"] - held["b"], True), "absent": (0, 0, False)}
    assert rep["a"].left_out > 0
