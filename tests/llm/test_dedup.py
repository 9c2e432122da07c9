"""Exact groups, line dedup and the Jaccard join against brute force, with the awkward rows of each."""

import random

import pytest

from lineloom.llm import exact_dedup, jaccard_join, line_dedup

ODD = [(900, None), (901, ""), (902, "   "), (None, "left alone"), (903, "x"), (903, "x"), (904, "\n\n")]


def words(rng, n, pool=400):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def test_exact_groups(frame):
    rng = random.Random(1)
    texts = [" ".join(words(rng, 30)) for _ in range(20)]
    rows = [(i, rng.choice(texts)) for i in range(80)] + ODD + [(200, texts[0][:-1] + "!"), (201, "é" * 40)]
    got = exact_dedup.exact_groups(frame(rows)).collect()
    assert len(got) == len(rows)
    groups = {}
    for key, text in rows:
        groups.setdefault(text or "", []).append(key)
    of = {}
    for keys in groups.values():
        named = [k for k in keys if k is not None]
        for k in keys:
            of.setdefault(k, []).append((max(named) if named else None, len(keys)))
    for r in got:
        assert (r["keep_id"], r["group_size"]) in of[r["doc_id"]]
    assert sum(r["kept"] for r in got) == len(groups)
    assert exact_dedup.exact_groups(frame([])).count() == 0


def edits(a, b):
    """Word edit distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, line):
    line, at = list(line), rng.randrange(len(line))
    kind = rng.randrange(3)
    if kind == 0:
        del line[at]
    elif kind == 1:
        line.insert(at, "new")
    else:
        line[at] = "other"
    return line


def test_line_dedup(frame):
    rng = random.Random(2)
    base = [words(rng, n, 60) for n in (1, 3, 8, 9, 10, 12, 25, 40) for _ in range(3)]
    pool = base + [edited(rng, b) for b in base for _ in range(3)]
    pool += [edited(rng, b) for b in pool if b]
    rows = [(i, "\n".join(" ".join(w) for w in rng.sample(pool, 4))) for i in range(60)] + ODD
    flat = []
    for key, text in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        flat += [(key, i, line.split()) for i, line in enumerate((text or "").split("\n")) if line.split()]
    want = {}
    for n, (key, i, line) in enumerate(flat):
        for other_key, j, other in flat[: n + 1]:
            near = min(len(line), len(other)) >= 8 and abs(len(line) - len(other)) < 2 and edits(line, other) <= 1
            if (other == line or near) and (key, i) not in want:
                want[key, i] = (other_key, j, other != line)
    got = line_dedup.dedup_lines(frame(rows)).collect()
    assert len(got) == len(flat)
    for r in got:
        key, i, near = want[r["doc_id"], r["line"]]
        assert (r["keep_id"], r["keep_line"], r["near"]) == (key, i, near), r
        assert r["kept"] == ((key, i) == (r["doc_id"], r["line"]))
    assert any(r["near"] for r in got)
    texts = {r["doc_id"]: r["text"] for r in line_dedup.without_repeated_lines(frame(rows)).collect()}
    assert texts[900] is None and texts[901] == "" and texts[902] == "   "
    kept = {(r["doc_id"], r["line"]) for r in got if r["kept"]}
    for key, text in rows:
        if any((key, i) in kept for i in range(9)) and key is not None:
            lines = text.split("\n")
            assert texts[key] == "\n".join(t for i, t in enumerate(lines) if (key, i) in kept or not t.split())
    assert line_dedup.dedup_lines(frame([])).count() == 0


def test_rows_of_one_key_lose_their_own_lines_only(frame):
    rows = [(7, "head one two\nfoo bar"), (7, "foo bar\nonly here and nowhere else"), (None, "left alone\nfoo bar"), (None, "foo bar"), (9, "foo bar\n\nlast one"), (9, "foo bar\n\nlast one")]
    docs = frame(rows)
    for name in ("_key", "_cut", "_any", "_mark", "mark", "line"):
        docs = docs.withColumn(name, docs["n_chars"])
    got = line_dedup.without_repeated_lines(docs)
    assert got.columns == docs.columns
    # Null keys come first, so their "foo bar" is the earliest; the row that holds nothing else keeps it.
    assert sorted(((r["doc_id"] is not None, r["doc_id"]), r["text"]) for r in got.collect()) == [
        ((False, None), "foo bar"), ((False, None), "left alone"), ((True, 7), "head one two"),
        ((True, 7), "only here and nowhere else"), ((True, 9), "\nlast one"), ((True, 9), "\nlast one"),
    ]


def linked(rows, size, percent):
    """Set sizes and components by brute force."""
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        take = min(size, len(w))
        sets.append({tuple(w[i : i + take]) for i in range(len(w) - take + 1)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least.setdefault(find(i), []).append(key)
    return [(key, len(sets[i]), min((k for k in least[find(i)] if k is not None), default=None)) for i, (key, _) in enumerate(rows)]


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80)])
def test_jaccard_join(frame, size, percent):
    rng = random.Random(3)
    passage = words(rng, 60)
    rows = []
    for base in [words(rng, n) for n in (2, 5, 40, 80, 200)] + [passage + words(rng, 8)]:
        for _ in range(18):
            copy = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 3, 5))):
                copy = edited(rng, copy) if len(copy) > 1 else copy
            rows.append((len(rows), " ".join(copy)))
    # Many texts that share a passage, with and without enough of their own.
    rows += [(1000 + i, " ".join(passage + words(rng, rng.randrange(0, 25)))) for i in range(60)]
    rows += [(2000, rows[3][1].upper()), *ODD]
    got = sorted(jaccard_join.near_duplicates(frame(rows), size=size, percent=percent).collect(), key=str)
    assert [tuple(r) for r in got] == [tuple(r) for r in sorted((type(got[0])(doc_id=a, n_shingles=b, component_id=c) for a, b, c in linked(rows, size, percent)), key=str)]
    assert jaccard_join.near_duplicates(frame([])).count() == 0


def linked_ids(rows, size, percent):
    """Smallest reachable key per key, by all pairs."""
    sets = {}
    for key, text in rows:
        w = text.lower().split()
        sets[key] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


def test_edits_of_one_text(frame):
    """Hardly any of the edits are linked, and all lie at much the same distance from any of them."""
    rng = random.Random(4)
    base, other = words(rng, 120, 5000), words(rng, 120, 5000)
    rows = []
    for i in range(300):
        text = list(base if i % 10 else base[:60] + other[60:])
        for at in rng.sample(range(120), rng.randrange(3, 9)):
            text[at] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    # Edits of edits, which are linked to one another only.
    for i in range(40):
        text = rows[rng.randrange(300)][1].split()
        text[rng.randrange(120)] = "again"
        rows.append((300 + i, " ".join(text)))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(frame(rows)).collect()}
    assert got == linked_ids(rows, 4, 85)
    assert len(set(got.values())) > 100


def test_unlinked_edits_hardly_meet(frame, monkeypatch):
    """Edits too far from their text and from one another, and few close pairs of them, ask few distances."""
    rng = random.Random(6)
    base = words(rng, 120, 5000)
    rows = []
    for i in range(300):
        text = list(base)
        for at in rng.sample(range(120), rng.randrange(6, 15)):
            text[at] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    for i in range(20):
        text = rows[rng.randrange(300)][1].split()
        text[rng.randrange(120)] = "again"
        rows.append((300 + i, " ".join(text)))
    asked, ask = [], jaccard_join._Distances.ask

    def counted(self, pairs):
        ask(self, pairs)
        asked.append(self.known.count())

    monkeypatch.setattr(jaccard_join._Distances, "ask", counted)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(frame(rows)).collect()}
    assert got == linked_ids(rows, 4, 85)
    assert 250 < len(set(got.values())) < 301
    assert 10 * asked[-1] < 320 * 319 // 2, asked


def test_one_of_each(frame):
    text = "one two three four five six seven eight nine ten"
    rows = [(5, text), (3, text), (3, text), (9, "something else altogether that nobody else has written here"), (7, None)]
    assert sorted(r["doc_id"] for r in jaccard_join.one_of_each(frame(rows)).collect()) == [3, 7, 9]
