import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm.packing import Plan, fill_report, pack_documents, packed
from ledgerloom.llm.tokens import encoding, with_tokens, TOKENIZER

PACKS = "pack_name string, capacity_tokens int, tokens string"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=200), st.integers(40, 50))
def test_a_plan_is_best_fit_decreasing(sizes, capacity):
    plan = Plan(Counter(sizes), capacity)
    order = sorted(sizes, reverse=True)
    ranks, seen = [], Counter()
    for s in order:
        ranks.append(seen[s])
        seen[s] += 1
    placed = plan.place(np.array(order, dtype=np.int64), np.array(ranks, dtype=np.int64))
    load = Counter()
    for s, c in zip(order, placed):
        load[int(c)] += s
    assert all(v <= capacity for v in load.values()) and len(load) == plan.containers
    gaps = []  # one item at a time, each into the smallest gap it fits
    for s in order:
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - s)
        else:
            gaps.append(capacity - s)
    assert sorted(load.values()) == sorted(capacity - g for g in gaps)


@pytest.mark.parametrize("slice_rows", [7, 1_000_000])
def test_every_item_is_placed_once(spark, slice_rows):
    rng = random.Random(3)
    items = [(i, rng.choice([0, 1, 5, 17, 64, 64, 64, 100, 250])) for i in range(300)] + [(1000, None), (None, 5)]
    sizes = spark.createDataFrame([(*x, 1) for x in items], "doc_id bigint, tokens bigint, piece int")
    packs = spark.createDataFrame([("s", 64, "x"), ("l", 300, "x"), (None, 10, "x"), ("none", 0, "x"), ("s", 32, "x")], PACKS)
    got = packed(sizes, packs, slice_rows=slice_rows).collect()
    load = Counter()
    for r in got:
        load[r.pack_name, r.container_id] += r.tokens
    assert all(v <= {"s": 64, "l": 300}[p] for (p, _), v in load.items())
    for pack, capacity in (("s", 64), ("l", 300)):
        pieces = {}
        for r in got:
            if r.pack_name == pack:
                pieces.setdefault(r.doc_id, []).append((r.piece_no, r.from_token, r.tokens))
        assert set(pieces) == {i for i, _ in items if i is not None}
        for i, t in items:
            if i is not None:
                assert sorted(pieces[i]) == [(n, n * capacity, min(capacity, (t or 0) - n * capacity)) for n in range(max(1, -(-(t or 0) // capacity)))]
    report = {r.pack_name: r for r in fill_report(packed(sizes, packs), packs).collect()}
    assert report["s"].tokens == sum(t or 0 for i, t in items if i is not None) and report["s"].fill > 0.95


def test_nothing_to_pack(spark):
    sizes = spark.createDataFrame([], "doc_id bigint, tokens bigint")
    packs = spark.createDataFrame([("s", 64, "x")], PACKS)
    assert packed(sizes, packs).count() == 0 and packed(spark.createDataFrame([(1, 2)], "doc_id bigint, tokens bigint"), packs.limit(0)).count() == 0


def test_whole_texts_are_counted(spark):
    texts = [(1, "Order. The member will be heard."), (2, None), (3, ""), (4, " "), (5, "<|endoftext|>"), (6, "palabra " * 30_000)]
    got = {r.doc_id: r.tokens for r in with_tokens(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    code = encoding(TOKENIZER)
    assert got == {i: len(code.encode_ordinary(t)) if t else 0 for i, t in texts} and got[6] >= 30_000
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert pack_documents(docs, spark.createDataFrame([("s", 512, "x")], PACKS)).groupBy("container_id").sum("tokens").where("`sum(tokens)` > 512").count() == 0


def test_a_capacity_beyond_any_text(spark):
    sizes = spark.createDataFrame([(i, 1000 * i) for i in range(1, 50)], "doc_id bigint, tokens bigint")
    packs = spark.createDataFrame([("huge", 2_000_000_000)], "pack_name string, capacity_tokens int")
    found = packed(sizes, packs).collect()
    assert len(found) == 49 and {r.container_id for r in found} == {0} and all(r.piece_no == 0 for r in found)
