"""The filter audit, packing and periodic runs against brute force."""

import functools
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lineloom.llm import filter_audit, pack_plan, packing, periodic, queries

ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "é　\x00 b\r\n"), (904, "<|endoftext|> a<|endoftext|>"), (905, "x" * 5000), (906, "the " * 3000), (906, "the " * 3000), (907, None), (None, "the " * 3000), (None, None), (908, "日本語 текст ʼn ɐ " * 40)]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- filter audit


def brute_audit(rows, labels):
    """All orders by walking each row through each of them."""
    first = {}
    for key, text, *_ in rows:
        if key is not None:
            first[text or ""] = min(key, first.get(text or "", key))
    good, toxic = {k for k, q, _ in labels if q == 1}, {k for k, _, t in labels if t == 1}
    parts, out = defaultdict(list), {}
    for key, text, *rest in rows:
        text, words = text or "", words_of(text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": key is not None and key > first[text],
        }
        parts[(rest[0] if rest else "s") or ""].append((key, {f for f, bad in fails.items() if bad}))
    for part, members in parts.items():
        total = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                before, failing = set(order[: step - 1]), [m for m in members if letter in m[1]]
                removed = [m for m in failing if not m[1] & before]
                total[letter] += len(removed)
                out[part, order, step] = [
                    sum(not m[1] & (before | {letter}) for m in members), len(removed), len(failing) - len(removed),
                    sum(m[1] == {letter} for m in members), sum(m[0] in good for m in removed), sum(m[0] in toxic for m in removed),
                ]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit(spark, frame):
    rng = random.Random(5)
    body = lambda: " ".join(rng.choice(["a", "B", "cd", "e#", "fgh"] + [f"w{i}" for i in range(400)]) for _ in range(rng.randrange(1, 500)))
    rows = [(i, body(), rng.choice(["x", "y", "", None])) for i in range(60)]
    rows += [(100 + i, rows[i % 7][1], "x") for i in range(30)] + [(r[0], r[1], "z") for r in ODD] + [(3, rows[3][1], "y")]
    labels = [(r[0], rng.randrange(2), rng.randrange(2)) for r in rows if r[0] is not None and rng.random() < 0.6]
    marks = spark.createDataFrame(labels + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    cells = filter_audit.failure_cells(frame(rows), marks)
    got = {(r["part"], r["filter_order"], r["step"]): (*(r[c] for c in filter_audit.COUNTS), r["shapley"]) for r in filter_audit.audit(cells, "ABCDE").collect()}
    assert got == brute_audit(rows, labels)
    assert filter_audit.audit(filter_audit.failure_cells(frame([]), marks), "ABCDE").count() == 0
    two = filter_audit.audit(filter_audit.failure_cells(frame(rows), marks), "AB")
    assert two.select("part", "filter_order", "step").distinct().count() == two.count() == 4 * len({(r[2] or "") for r in rows})
    for letters in ("", "AA", "ABCDEFG"):
        with pytest.raises(ValueError):
            filter_audit.walk_orders(cells, letters)


def test_filter_audit_equals_its_sql(spark, small):
    import compare

    got = compare.spark_rows(queries.QUERIES["op11_filter_audit"](spark, small))
    want = compare.duck_rows(compare.connect(small), queries.ORACLES["op11_filter_audit"])
    assert got[1] and compare.difference(got, want) is None


# --- packing


def test_knapsack_is_optimal():
    rng = random.Random(2)
    for _ in range(30):
        lengths = np.array(sorted(rng.sample(range(1, 20), 5)))
        prices = np.array([rng.random() for _ in lengths])
        best, last = pack_plan.knapsack(lengths, prices, 30)
        top = [0.0] * 31
        for room in range(1, 31):
            top[room] = max([top[room - 1]] + [top[room - n] + p for n, p in zip(lengths, prices) if n <= room])
        assert best == pytest.approx(top)
        for room in range(31):
            taken = list(pack_plan.filled(lengths, last, room))
            assert lengths[taken].sum() <= room and prices[taken].sum() == pytest.approx(best[room])


@pytest.mark.parametrize("capacity, kinds", [(20, [3, 7, 10]), (64, list(range(1, 65))), (100, [34, 51]), (64, [64]), (64, [])])
@pytest.mark.parametrize("times", [1, 1000])
def test_plan_serves_every_piece(capacity, kinds, times):
    rng = np.random.default_rng(3)
    lengths = np.array(kinds, np.int64)
    demand = rng.integers(1, 9, len(kinds)) * times
    served, used = Counter(), 0
    for configuration, number in pack_plan.plan(lengths, demand, capacity):
        assert number > 0 and sum(configuration) <= capacity
        used += number
        for length in configuration:
            served[length] += number
    assert served == Counter(dict(zip(kinds, demand.tolist())))
    greedy = sum(pack_plan.best_fit(lengths, demand, capacity).values())
    least = -(-int((lengths * demand).sum()) // capacity)
    assert least <= used <= greedy * 1.01 + 1


def test_plan_beats_best_fit_where_sizes_must_meet():
    """Best fit pairs the large pieces badly here; 6 + 7 + 7 and 10 + 10 fill every sequence."""
    lengths, demand = np.array([6, 7, 10]), np.array([1000, 2000, 2000])
    assert sum(n for _, n in pack_plan.plan(lengths, demand, 20)) <= 2010


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.model_path(packing.TOKENIZER))


def library_ids(text):
    return library().encode(text or "", add_special_tokens=False).ids


def test_splitting_equals_the_library():
    encoder = packing.TokenBytes(packing.TOKENIZER)
    assert encoder.fast is not None
    for point in range(0x250):
        c = chr(point)
        for text in (c, f"a{c}b", f" {c} 1{c}{c}  x", f"{c}'s{c}\n{c}"):
            assert np.frombuffer(encoder.of(text), "<u4").tolist() == library_ids(text), hex(point)


def test_merging_by_rank_equals_merging_by_rule():
    """Every vocabulary string, alone, is one token: the proof that ``TokenBytes`` rests on."""
    model, vocabulary = library().model, library().get_vocab(with_added_tokens=False)
    assert [t for t, i in vocabulary.items() if t != "<|endoftext|>" and [k.id for k in model.tokenize(t)] != [i]] == []
    encoder, rng = packing.TokenBytes(packing.TOKENIZER), random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choice("aeinrst hl.,'éß0\n") for _ in range(rng.randrange(1, 200)))
        assert np.frombuffer(encoder.of(text), "<u4").tolist() == library_ids(text), text


def check_packing(rows, placed, capacity):
    pieces = defaultdict(list)
    for r in placed:
        pieces[r["sequence_id"]].append(r)
    for own in pieces.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    want = Counter()
    for key, text, *_ in rows:
        ids = library_ids(text) + [2]
        first = (len(ids) - 1) % capacity + 1
        starts = [0, *range(first, len(ids), capacity)]
        for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[key, i, a, b - a, np.array(ids[a:b], "<u4").tobytes()] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in placed) == want
    return len(pieces)


def test_packing(spark, frame):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["alpha", "be", "GAMMA", "d'elta", "éé"]) for _ in range(rng.randrange(0, 120)))) for i in range(150)]
    rows += [(r[0], r[1]) for r in ODD]
    for capacity in (32, 1024):
        placed = packing.pack_documents(frame(rows).repartition(5), capacity=capacity)
        got = placed.collect()
        used = check_packing(rows, got, capacity)
        total = sum(r["length"] for r in got)
        assert used <= 1.02 * -(-total // capacity) + 2
    packed = packing.sequences(placed).collect()
    by_id = defaultdict(list)
    for r in got:
        by_id[r["sequence_id"]].append(r)
    assert {r["sequence_id"] for r in packed} == set(by_id)
    for r in packed:
        own = sorted(by_id[r["sequence_id"]], key=lambda p: p["offset"])
        assert bytes(r["ids"]) == b"".join(bytes(p["ids"]) for p in own) and r["length"] == sum(p["length"] for p in own)
        assert [(p["doc_id"], p["piece"]) for p in r["parts"]] == [(p["doc_id"], p["piece"]) for p in own]
    assert packing.pack_documents(frame([])).count() == 0


def test_packing_with_a_large_table_of_counts(spark, frame, monkeypatch):
    """The join that takes the place of the broadcast gives the same kind of packing."""
    monkeypatch.setattr(packing, "small_side", lambda df, rows: df)
    rows = [(i, "word " * (i % 11)) for i in range(200)]
    check_packing(rows, packing.pack_documents(frame(rows).repartition(7), capacity=16).collect(), 16)


def test_packing_query(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = queries.QUERIES["op12_best_fit_packing"](spark, small).collect()
    want = set()
    for key, text in rows:
        ids = library_ids(text) + [2]
        starts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids), 1024)]
        want |= {(key, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)]))}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)


# --- periodic runs


def brute_runs(ids, least=12):
    """Every period, smallest first; a stretch keeps the first period that explains it."""
    n, found = len(ids), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ids[j] == ids[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def sequences_of_words():
    rng = random.Random(11)
    yield from ([], [0], [0] * 11, [0] * 12, [0] * 500, [0, 1] * 200 + [1, 0] * 200, list(range(100)) * 2, list(range(100)) + list(range(99)))
    a, b = [0], [0, 1]
    for _ in range(12):
        a, b = b, b + a
    yield b  # a Fibonacci word: runs of many periods
    thue = [0]
    for _ in range(9):
        thue += [1 - x for x in thue]
    yield thue
    for p in (2, 3, 5, 8, 16, 17, 33):
        root = [rng.randrange(2) for _ in range(p)]
        # Touching stretches of one period, at every shift, and their copies.
        for shift in {0, 1, p // 2, p - 1}:
            left = (root * 60)[: 40 * p // p + 90]
            yield left + ((root[shift:] + root[:shift]) * 60)[:130]
        yield ((root * 9)[: 9 * p - 1] + [7]) * 6
    for k in range(120):
        n, kinds = rng.randrange(12, 420), rng.choice([1, 2, 2, 3, 5, 40])
        text = [rng.randrange(kinds) for _ in range(n)]
        for _ in range(rng.randrange(4)):
            at, p = rng.randrange(n), rng.randrange(1, 90)
            for i in range(at, min(n, at + rng.randrange(2, 6) * p)):
                text[i] = text[at + (i - at) % p]
        yield text


def test_runs_equal_brute_force():
    for text in sequences_of_words():
        ids = np.array(text, np.int64)
        assert periodic.Runs(ids).spans() == brute_runs(text), text
        assert periodic.Runs(ids, 30).spans() == brute_runs(text, 30), text
    with pytest.raises(ValueError):
        periodic.Runs(np.zeros(9, np.int64), 3)


def test_long_periodic_texts_stay_cheap():
    import time

    start = time.perf_counter()
    n = 400_000
    assert periodic.Runs(np.zeros(n, np.int64)).spans() == [(0, n, 1)]
    rng = np.random.default_rng(1)
    root = rng.integers(0, 1000, n // 3)
    assert periodic.Runs(np.tile(root, 3)).spans() == [(0, 3 * (n // 3), n // 3)]
    dull = np.tile(np.append(np.zeros(999, np.int64), 1), 400)
    assert (0, n, 1000) in periodic.Runs(dull).spans()
    assert time.perf_counter() - start < 60


def planted_words(key, words):
    n, h = len(words), zlib.crc32(str(key).encode()) if key is not None else 1
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def digest_of(key, text):
    words = planted_words(key, words_of(text))
    number = {}
    runs = brute_runs([number.setdefault(w, len(number)) for w in words])
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (
        key, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_periodic_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r[0], r[1]) for r in docs if len(r[1] or "") < 9000]
    got = {r["doc_id"]: tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, small).collect()}
    assert len(got) == len(docs)
    for key, text in rows:
        assert got[key] == digest_of(key, text)
    assert sum(r[1] > 0 for r in got.values()) >= 0.09 * len(got), "the planted tails are runs"


def test_periodic_runs_on_odd_rows(frame):
    rows = [(r[0], r[1]) for r in ODD if r[1] is None or len(r[1]) < 3000] + [(7, "a b c d " * 5), (7, "a b c d " * 5)]
    got = Counter((r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in periodic.periodic_runs(frame(rows)).collect())
    want = Counter()
    for key, text in rows:
        words = words_of(text)
        runs = brute_runs(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        want[key, len(words), tuple(runs), " ".join(w for i, w in enumerate(words) if i not in gone)] += 1
    assert got == want
    assert periodic.periodic_runs(frame([])).count() == 0
