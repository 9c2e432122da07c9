"""Targets, draws and permutations of the mix; the pipeline's stages; every corpus query."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lineloom.llm import mixing
from lineloom.llm.queries import ORACLES, QUERIES


def water(sizes):
    """Targets by capping whatever is above its cap until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        free = [s for s in order if s not in capped]
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        above = {s for s in free if share[s] > 3 * sizes[s]}
        if not above:
            return {s: 3.0 * sizes[s] if s in capped else share[s] for s in order}
        capped |= above


@pytest.mark.parametrize("seed", range(3))
def test_mix(frame, seed):
    rng = random.Random(seed)
    rows = []
    for source, docs in (("a", 300), ("b", 4), ("c", 40), ("d", 1), (None, 30), ("é", 0)):
        rows += [(len(rows) + i, " ".join(["w"] * rng.randrange(0, 400)), source) for i in range(docs)]
    rows += [(9000, None, "a"), (9001, "", "é"), (9001, "", "é"), (9002, "one two", "a"), (9002, "one two", "a")]
    got = mixing.mix_sources(frame(rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    targets, taken = water(sizes), {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for source, words in taken.items():
        assert abs(words - targets[source]) <= max(2 * mixing.BLOCK, 0.02 * targets[source])
    again = mixing.mix_sources(frame(list(reversed(rows))).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix_sources(frame([])).count() == 0


def test_blocks_of_the_mix(frame):
    """Every slot holds one whole block, and the emitted parts are the words of the slots."""
    rng = random.Random(8)
    text = lambda i, n: "  " * (i % 2) + "".join(f"d{i}w{j}" + rng.choice((" ", "\n", " \t ")) for j in range(n))
    rows = [(i, text(i, rng.randrange(0, 300)), "ab"[i % 2]) for i in range(60)]
    rows += [(100, text(100, 20_000), "c"), (101, None, "a"), (102, text(102, 90), None), (7, text(107, 130), "b"), (7, text(107, 130), "b")]
    docs = frame(rows, extra=False)
    words = defaultdict(list)
    for key, body, _ in rows[:-2]:
        words[key].append((body or "").split())
    slots, taken, counts = defaultdict(list), Counter(), Counter()
    for r in mixing.mixed_blocks(docs).collect():
        slots[r["shard"], r["slot"]].append(r)
        taken[r["doc_id"]] += r["words"]
        if r["doc_id"] != 7:
            counts.update(words[r["doc_id"]][0][r["first"] : r["first"] + r["words"]])
    assert sorted(shard * mixing.SHARD_SLOTS + slot for shard, slot in slots) == list(range(len(slots)))
    sizes = Counter()
    for _, body, source in rows:
        sizes[source] += len((body or "").split())
    for spans in slots.values():
        source, block = {(r["source"], r["block"]) for r in spans}.pop()
        assert len({(r["source"], r["block"], r["repeat"]) for r in spans}) == 1
        at = 0
        for r in sorted(spans, key=lambda r: r["at"]):
            assert r["at"] == at
            at += r["words"]
        assert at == min(mixing.BLOCK, sizes[source] - block * mixing.BLOCK)
    summed = Counter()
    for r in mixing.mix_sources(docs).collect():
        summed[r["doc_id"]] += r["taken"]
    assert {k: v for k, v in summed.items() if v} == dict(taken)
    bodies, parts, out = defaultdict(set), mixing.mixed_documents(docs).collect(), Counter()
    for key, body, _ in rows:
        bodies[key].add(body or "")
    for r in parts:
        assert any(r["text"] in body for body in bodies[r["doc_id"]]) and r["text"].split()
        if r["doc_id"] != 7:
            out.update(r["text"].split())
    assert out == counts and sum(len(r["text"].split()) for r in parts) == sum(taken.values())
    # The one long text of its source is neither dropped nor repeated whole.
    long = sum(len(r["text"].split()) for r in parts if r["doc_id"] == 100)
    target = water(sizes)["c"]
    assert abs(long - target) <= 2 * mixing.BLOCK and target % 20_000


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_permutation(spark, n):
    rows = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit("s"), F.lit(3)).alias("p")).collect()
    assert sorted(r["p"] for r in rows) == list(range(n))


def test_pipeline_stages(spark, frame):
    rng = random.Random(1)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    rows = [(i, text(120) + "\n" + text(80), "ab"[i % 2]) for i in range(40)]
    clean = {r[0] for r in rows}
    rows += [(100, rows[0][1]), (101, "spam words " * 60), (102, None), (103, ""), (104, rows[1][1].replace("w1", "v1"))]
    docs = frame(rows, extra=False)
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
        assert docs.columns == names, name
        ids = {r["doc_id"] for r in docs.collect()}
        if name != "mixing":
            assert clean <= ids, name
        assert not ids & {101, 102, 103}
        if name in ("line_dedup", "jaccard_join"):
            assert 100 not in ids
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert last and all(r["round_trip"] for r in last)


def test_stages_on_an_empty_table(spark, frame):
    docs = frame([], extra=False)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_oracles(spark, small):
    import compare

    con = compare.connect(small)
    for name, sql in ORACLES.items():
        assert compare.difference(compare.spark_rows(QUERIES[name](spark, small)), compare.duck_rows(con, sql)) is None, name
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
