"""Operators that look at each text by itself, against brute force, the library, round trips and held-out rows."""

import math
import random
import re
import textwrap
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from lineloom.llm import codec, langid, license_scan, lm_score, pieces, quality, token_counts

ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "é　\x00 ▁a ▁▁ b\r\n"), (904, "<s> </s> <unk>"), (905, "x" * 5000), (906, "the " * 3000), (906, "the " * 3000)]


@pytest.fixture(scope="module")
def texts(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "source", "lang").collect()
    return [tuple(r) for r in rows]


def test_token_counts_equal_the_library(frame, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    rows = texts + ODD
    got = token_counts.token_counts(frame(rows)).collect()
    want = Counter((k, len((t or "").encode()), len(library.encode(t or ""))) for k, t, *_ in rows)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got)
    assert token_counts.token_counts(frame([])).count() == 0


def best_score(text, v):
    """Score of the best segmentation by plain dynamic programming over the whole text."""
    best = [0.0] + [-math.inf] * len(text)
    for i in range(len(text)):
        if text[i] not in v.normal:
            best[i + 1] = max(best[i + 1], best[i] + v.real_low - 10)
        for j in range(i + 1, min(len(text), i + v.longest) + 1):
            if text[i:j] in v.normal:
                best[j] = max(best[j], best[i] + v.normal[text[i:j]][1])
    return best[-1]


def test_texts_without_spaces_take_linear_time():
    rng = random.Random(6)
    coder = codec.Codec(pieces.pieces())
    for alphabet in ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "的一是不了人我在有他这为之大来以个中上们"):
        text = "".join(rng.choice(alphabet) for _ in range(400_000))
        start = time.perf_counter()
        ids = coder.encode(text)
        assert time.perf_counter() - start < 60
        assert coder.decode(np.frombuffer(ids, np.int32)) == text.encode()
    whole = codec.StreamingViterbi(coder.v)
    assert coder.encode(text[:9000]) == np.array(whole.feed(pieces.MARK + text[:9000]) + whole.finish(), np.int32).tobytes()


def test_long_segments_are_not_remembered():
    counter = token_counts.SegmentCounts(pieces.DEFAULT_MODEL)
    before = len(counter)
    assert counter.count("q" * 100_000) > 0 and counter.count("zqxj") > 0
    assert len(counter) <= before + 1


def test_streaming_viterbi_is_exact(texts):
    v, rng = pieces.pieces(), random.Random(4)
    for _, text, *_ in texts[:25]:
        marked = "▁" + text[:600].replace(" ", "▁").replace("\n", "")
        search, ids, at, waiting = codec.StreamingViterbi(v), [], 0, 0
        while at < len(marked):
            step = rng.randrange(1, 9)
            ids += search.feed(marked[at : at + step])
            at, waiting = at + step, max(waiting, len(search.text))
        ids += search.finish()
        assert "".join(v.names[i] for i in ids) == marked
        assert sum(v.normal[v.names[i]][1] for i in ids) == pytest.approx(best_score(marked, v))
        assert waiting <= 6 * v.longest, "the window stays short"
        whole = np.frombuffer(codec.codec().encode(marked[1:].replace("▁", " ")), np.int32)
        assert whole.tolist() == ids


def test_round_trip(frame, texts):
    rows = texts + ODD
    done = codec.encode_documents(frame(rows))
    got = done.collect()
    assert len(got) == len(rows) and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in got)
    back = Counter((r["doc_id"], r["text"]) for r in codec.decode_documents(done).collect())
    assert back == Counter((k, t or "") for k, t, *_ in rows)
    assert codec.encode_documents(frame([])).count() == 0


def brute_quality(text):
    words = (text or "").split()
    n = len(words)
    longest = [max((next((z for z in range(n) if max(i, j) + z >= n or words[i + z] != words[j + z]), n) for j in range(n) if j != i), default=0) for i in range(n)]
    cover = lambda least: len({p for i, m in enumerate(longest) if m >= least for p in range(i, i + m)})
    lines = [x for x in (text or "").split("\n") if x.split()]
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), cover(3), cover(5), max(longest, default=0)


def test_quality(frame):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("a b c d e é".split()) if i % 3 else f"u{rng.randrange(90)}" for _ in range(i * 2)) + "\nrow #1 row\nrow #1 row") for i in range(50)]
    rows += [(100, " ".join(f"w{i}" for i in range(70)) * 2), (101, " ".join(f"w{i}" for i in range(200))), *ODD[:5]]
    got = {r["doc_id"]: r for r in quality.quality_rules(frame(rows)).collect()}
    for key, text, *_ in rows:
        r = got[key]
        want = brute_quality((text or "").replace("\x00", "\x00").replace("　", "　")) if key != 903 else None
        if want:
            assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")) == want, key
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        if r["base_failed"]:
            assert not r["kept"]
    assert got[101]["kept"] and not got[100]["kept"]
    assert quality.quality_rules(frame([])).count() == 0


def test_language_id(frame, texts):
    rows = texts + [(900, None), (901, "12 -- 34"), (902, "")]
    docs = frame(rows)
    held = {k for k, *_ in texts if zlib.crc32(str(k).encode()) % 4 == 2}
    model = langid.fit_languages(docs.where(~docs["doc_id"].isin(sorted(held))).where("doc_id < 900"))
    assert sorted(x for g in model.families for x in g) == sorted({r[3] for r in texts}) and len(model.families) == 2
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict_languages(docs, model).collect()}
    right = [got[k][0] == lang for k, _, _, lang in texts if k in held]
    assert sum(right) >= 0.97 * len(right)
    assert all(got[k][0] == "und" for k in (900, 901, 902)) and all(0 <= s <= 1 for _, s in got.values())
    assert langid.fit_languages(frame([])) is None
    assert langid.predict_languages(docs, None).where("lang_pred <> 'und'").count() == 0


def test_every_language_is_learned(frame):
    rng, rows = random.Random(3), []
    for i in range(70):
        vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 8))) for _ in range(12)]
        # The last languages are the rarest.
        rows += [(len(rows), " ".join(rng.choice(vocabulary) for _ in range(60)), "s", f"l{i:02d}") for _ in range(5 if i < 60 else 3)]
    docs = frame(rows)
    for model in (langid.fit_languages(docs), langid.fit_languages(docs.where("lang < 'l09'"), driver_languages=2)):
        names = sorted(x for g in model.families for x in g)
        few = len(names) < 70
        assert names == sorted({r[3] for r in rows if not few or r[3] < "l09"})
        x = np.array([langid.features(r[1]) for r in rows if r[3] in names])
        assert model.predict(x)[0] == [r[3] for r in rows if r[3] in names]
    here = langid.fit_languages(docs.where("lang < 'l09'"))
    assert here.families == model.families
    assert np.allclose(here.predict(x)[1], model.predict(x)[1], atol=0.05)


def test_lm_scores(frame, texts):
    from pyspark.sql import functions as F

    rows = texts + [(900, None), (901, ""), (902, "The THE zzzz")]
    got = {r["doc_id"]: r for r in lm_score.lm_scores(frame(rows), F.crc32(F.col("doc_id").cast("string")) % 7 == 2).collect()}
    split = {k: (t or "").encode().lower().split() + [b" "] for k, t, *_ in rows}
    out = {k for k in split if zlib.crc32(str(k).encode()) % 7 == 2}
    counts = Counter(w for k, ws in split.items() if k not in out for w in ws)
    total, room = sum(counts.values()), sum(counts.values()) + len(counts) + 1
    model = base = 0.0
    for k, ws in split.items():
        r = got[k]
        want = sum(math.log10((counts[w] + 1) / room) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (k in out, len(ws), sum(counts[w] > 0 for w in ws), total)
        assert r["base_score"] == pytest.approx(want) and r["score"] < 0
        if k in out:
            model, base = model + r["score"], base + want
    assert model > base, "context helps on held-out rows"
    assert lm_score.lm_scores(frame([]), F.lit(False)).count() == 0


def test_attention_is_causal_and_each_token_is_scored_once():
    rng = np.random.default_rng(1)
    net, x = lm_score.Attention(), rng.integers(0, lm_score.CLASSES, (3, lm_score.CONTEXT))
    later = x.copy()
    later[:, 9:] = 0
    a, b = (net._hidden(v)[-1] for v in (x, later))
    assert np.allclose(a[:, :9], b[:, :9]) and not np.allclose(a[:, 9:], b[:, 9:])
    for n in (1, 7, 8, 16, 17, 24, 25, 100):
        ids = np.arange(n)
        _, y, scored = lm_score.windows(ids, -1)
        assert sorted(y[scored].tolist()) == ids.tolist()
    y = np.roll(x, -1, axis=1)
    loss, grads = net.step(x, y, np.ones(x.shape, np.float32))
    for name in ("Q", "V", "E"):
        at, eps = (2, 3), 1e-2
        net.p[name][at] += eps
        up, _ = net.step(x, y, np.ones(x.shape, np.float32))
        net.p[name][at] -= 2 * eps
        down, _ = net.step(x, y, np.ones(x.shape, np.float32))
        net.p[name][at] += eps
        assert (up - down) / (2 * eps) == pytest.approx(float(grads[name][at]), abs=2e-3)


def test_license_scan(frame, texts):
    notices = list(license_scan.TEMPLATES.values())
    rows = texts + [(700 + i, f"before\n{n.upper()} extra\nafter") for i, n in enumerate(notices)]
    rows += [(800, "cc-by, CC  BY\nccby accc by all rights, reserved"), (801, "a general\npublic license"), (802, "é cc by"), (900, None), (901, "")]
    got = {r["doc_id"]: r for r in license_scan.license_scan(frame(rows)).collect()}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    sets = {label: set(words(t)) for label, t in license_scan.TEMPLATES.items()}
    for key, text, *_ in rows:
        w, r = words(text), got[key]
        places = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min(starts, default=None), max(starts, default=None)), key
        assert r["base_labels"] == ",".join(sorted({p for _, p in places}))
        best = {label: max(len(s & set(words(line))) / len(s) for line in (text or "").split("\n")) for label, s in sets.items()}
        found = {label for label, share in best.items() if share >= license_scan.CONTAINMENT}
        assert r["labels"] == ",".join(sorted({p for _, p in places} | found)), key
        assert r["score"] == pytest.approx(1.0 if places else max([0.0] + [best[x] for x in found]))
    assert license_scan.license_scan(frame([])).count() == 0


@pytest.mark.parametrize("columns", [24, 72])
def test_license_notices_wrapped_over_lines(frame, columns):
    labels = list(license_scan.TEMPLATES)
    rows, pad = [], "lorem ipsum dolor sit amet " * 20
    for i, notice in enumerate(license_scan.TEMPLATES.values()):
        wrapped = textwrap.wrap(notice, columns)
        rows += [(i, "\n".join(wrapped)), (100 + i, pad + "\n/*\n" + "".join(f" * {x}\r\n" for x in wrapped) + " */\n" + pad)]
    # Too few of the words, and all of them but far apart.
    mit = license_scan.TEMPLATES["mit"].split()
    rows += [(200, "\n".join(mit[:17])), (201, ("\n" + pad).join(mit))]
    got = {r["doc_id"]: r for r in license_scan.license_scan(frame(rows)).collect()}
    for i, label in enumerate(labels):
        for key in (i, 100 + i):
            assert label in got[key]["labels"].split(","), (label, columns)
            assert got[key]["score"] == 1.0
    assert got[200]["labels"] == "" and got[201]["labels"] == ""
    least = [r for r in license_scan.license_blocks(frame([(1, "\n".join(mit[:-1]))])).collect()]
    assert {r["label"] for r in least} == {"mit"} and max(r["overlap"] for r in least) == len({w.strip(",").lower() for w in mit[:-1]})


def test_lm_weights_learn_from_all_training_rows(frame, texts, monkeypatch):
    from pyspark.sql import functions as F

    # Next to nothing is drawn for the start, so a model that learned from it alone knows little of the rest.
    monkeypatch.setattr(lm_score, "FIT_WINDOWS", 4)
    monkeypatch.setattr(lm_score, "STEP", 64)
    rows, held = frame(texts), F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    total = lambda: sum(r["score"] for r in lm_score.lm_scores(rows, held).collect())
    whole = total()
    monkeypatch.setattr(lm_score, "_fit", lm_score._start)
    assert whole > total() + 100


def test_lm_texts_are_split_for_counts_and_classes_only(frame, texts, monkeypatch):
    from pyspark.sql import functions as F

    read, fit = [], lm_score._fit

    def watched(train, *more):
        read.append(train.columns)
        return fit(train, *more)

    monkeypatch.setattr(lm_score, "_fit", watched)
    got = lm_score.lm_scores(frame(texts + [(900, None)]), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
    assert got.count() == len(texts) + 1
    assert len(read) == 1 and "text" not in read[0], "training reads stored classes"


def test_gradients_of_classes_equal_a_sum_per_occurrence():
    rng = np.random.default_rng(2)
    net = lm_score.Attention()
    x, y = rng.integers(0, 5, (6, lm_score.CONTEXT)), rng.integers(0, lm_score.CLASSES, (6, lm_score.CONTEXT))
    valid = np.ones(x.shape, np.float32)
    whole = net.step(x, y, valid)[1]["E"]
    apart = sum(net.step(x[i : i + 1], y[i : i + 1], valid[i : i + 1])[1]["E"] for i in range(6)) / 6
    assert np.allclose(whole, apart, atol=1e-5) and not whole[5:].any()
    m, s = net.means()
    before = {n: w.copy() for n, w in net.p.items()}
    net.update(net.step(x, y, valid)[1], m, s, 1, 0.01)
    assert all((np.abs(net.p[n] - before[n]) < 0.0101).all() for n in before) and (net.p["U"] != before["U"]).any()


def test_rare_words_of_one_start_share_a_class(monkeypatch):
    """The leading piece is looked up once for words that differ behind the start it depends on; products in parts equal whole ones."""
    heads = {lm_score.head(w) for w in (b"qzxvkkw" + bytes([c]) * 9 for c in b"abcdefgh")}
    assert len(heads) == 1
    looked, find = [], lm_score.leading_piece
    scorer = lm_score.Scorer({}, np.zeros(0), {}, np.zeros(lm_score.CLASSES), 1, lm_score.DEFAULT_MODEL)
    monkeypatch.setattr(lm_score, "leading_piece", lambda w, m: looked.append(w) or find(w, m))
    words = [b"qzxvkkw" + bytes([c]) * 9 for c in b"abcdefgh"]
    assert [scorer.rare_class(w) for w in words] == [scorer.class_of(w) for w in words]
    assert len(looked) == 1 + len(words)
    rng = np.random.default_rng(1)
    for shape in ((1024, 16, 64), (16, 1024, 64), (1024, 64, 1), (3, 16, 48)):
        a, b = rng.random(shape[:2], np.float32), rng.random(shape[1:], np.float32)
        b = b[:, 0] if shape[2] == 1 else b
        assert np.allclose(lm_score._dot(a, b), a @ b, rtol=1e-5)
