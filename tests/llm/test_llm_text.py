"""Operators on documents against brute force, on small tables with nulls, ties, copies and odd texts."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from kindred.llm import decontaminate, language_id, lm_score, minhash_forest, packed, packing, substring_dedup, textkit, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def corpus(seed: int = 1, n: int = 60) -> list[tuple[int | None, str | None]]:
    """Random texts with copies, near copies, a shared passage, repeats, nulls, empties and a long text."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 7))) for _ in range(400)]
    line = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    texts: list[str | None] = [line(rng.randrange(1, 120)) for _ in range(n)]
    passage = line(60)
    for i in range(0, n, 7):
        texts[i] = f"{texts[i]} {passage}\t{line(5)}"
    texts += [texts[3], texts[3], texts[5].upper(), None, "", " \t\n ", "one", "two words", "same " * 50, "ab " * 70, line(3000), "Ünïcode ß ñandú " * 12, "a b c\x0bd\x1ce"]
    words = texts[10].split(" ")
    for k in range(3):
        near = list(words)
        near[(k * 5) % len(near)] = "changed"
        texts.append(" ".join(near))
    return list(enumerate(texts))


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).repartition(3)


def with_extras(df):
    """Columns of names that the operators use themselves."""
    from pyspark.sql import functions as F

    return df.select("*", F.lit("x").alias("score"), F.lit("y").alias("_text"), F.lit(1).alias("n_words"), F.lit("z").alias("spans"), F.lit("c").alias("chunk"))


def test_words_and_windows():
    texts = [t or "" for _, t in corpus()]
    import pyarrow as pa

    for pattern, table, lower in ((SPACED, textkit.PLAIN, False), (ALNUM, textkit.ALNUM, True)):
        data, offsets = textkit.utf8(pa.array(texts))
        words = textkit.Words(data, offsets, table)
        want = [pattern.findall(t.translate(LOWER) if lower else t) for t in texts]
        assert np.diff(words.first).tolist() == [len(w) for w in want]
        flat = [w for ws in want for w in ws]
        hashes = words.hashes(lower)
        assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))
        for size in (1, 2, 3, 7, 20):
            got = textkit.windows(hashes, size)
            keys = [tuple(flat[i : i + size]) for i in range(len(flat) - size + 1)]
            assert len(got) == len(keys) and len(set(zip(keys, got.tolist()))) == len(set(keys)) == len(set(got.tolist()))
    assert textkit.sliding_min(np.array([5, 3, 9, 1, 7, 8]), 3).tolist() == [3, 1, 1, 1]
    assert [x.tolist() for x in packed.unpack(packed.pack(np.arange(5, dtype="u8"), np.arange(5, dtype="i4")), "u8", "i4")] == [[0, 1, 2, 3, 4]] * 2


def removed_by_force(rows, size: int) -> dict[int, tuple[int, int, str]]:
    seen: set[tuple] = set()
    out = {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        words = SPACED.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - size + 1):
            key = tuple(words[i : i + size])
            if key in seen:
                gone[i : i + size] = [True] * size
            seen.add(key)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out[doc] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize(("window", "seed", "chunk"), [(20, 10, 8 << 20), (20, 10, 600), (20, 5, 2000), (8, 4, 900)])
def test_substring_dedup(spark, monkeypatch, window, seed, chunk):
    monkeypatch.setattr(packed, "CHUNK_BYTES", chunk)
    rows = corpus()
    got = substring_dedup.remove_repeats(with_extras(frame(spark, rows)), window=window, seed=seed).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in got} == removed_by_force(rows, window)


def test_substring_dedup_edges(spark):
    assert substring_dedup.levels(40, 10) == [10, 20] and substring_dedup.levels(20, 10) == [10]
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0
    text = " ".join(f"w{i}" for i in range(25))
    got = {(r["doc_id"], r["n_removed"]) for r in substring_dedup.remove_repeats(frame(spark, [(None, text), (4, text), (9, None)])).collect()}
    assert got == {(4, 0), (None, 25), (9, 0)}
    twice = substring_dedup.remove_repeats(frame(spark, [(4, text), (4, text)])).collect()
    assert sorted(r["n_removed"] for r in twice) == [0, 25]


def thue_morse(n: int) -> tuple[str, str]:
    """Two words of n letters that every polynomial hash modulo a power of two takes for equal, from 1,024 letters on."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_polynomials_confuse(spark, n):
    """Words and runs of words that differ in every letter, yet not for a polynomial, stay apart in every operator."""
    import pyarrow as pa

    one, two = thue_morse(n)
    for salt in (0, 1):
        assert len(set(textkit.Words(*textkit.utf8(pa.array([one, two])), textkit.ALNUM).hashes(True, salt).tolist())) == 2
    runs = [textkit.windows(textkit.Words(*textkit.utf8(pa.array([" ".join(x)])), textkit.ALNUM).hashes(True), n)[0] for x in (one, two)]
    assert runs[0] != runs[1]
    rest = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"{one} {rest}")]
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()} == {1: 0, 2: 0, 3: 20}
    short = [(1, one), (2, two), (3, one)]
    assert {r["doc_id"]: r["component_id"] for r in minhash_forest.near_duplicates(frame(spark, short)).collect()} == {1: 1, 2: 2, 3: 1}
    items = frame(spark, [(1, f"{one} only here")], "item_id long, text string")
    found = decontaminate.find_benchmark(frame(spark, [(1, f"{two} only here"), (2, f"so {one} only here")]), items).collect()
    assert {r["doc_id"]: r["items"] for r in found} == {1: [], 2: ["1"]}
    vile = toxicity.SegmentModel(textkit.Words(*textkit.utf8(pa.array([one])), textkit.ALNUM).hashes(True), np.array([2.0]), 0.5, 1.0, 0.0, np.zeros(3))
    assert [len(x) for x in toxicity.segments(vile, *textkit.utf8(pa.array([one, two])))[1]] == [1, 0]


def components_by_force(rows, percent: int) -> dict[int, tuple[int, int]]:
    sets = {}
    for doc, text in rows:
        words = SPACED.findall((text or "").translate(LOWER))
        sets[doc] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
    parent = {d: d for d in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    docs = sorted(sets)
    for i in docs:
        for j in docs:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), root(d)) for d in docs}


@pytest.mark.parametrize("percent", [85, 50])
def test_minhash_forest(spark, monkeypatch, percent):
    rows = corpus(3)
    want = components_by_force(rows, percent)
    got = minhash_forest.near_duplicates(with_extras(frame(spark, rows)), percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_minhash_forest_large_groups(spark, monkeypatch):
    """Regions beyond a task's share, regions cut deeper and groups compared block by block give the same groups."""
    rng = random.Random(11)
    base = [f"t{i}" for i in range(300)]
    rows = []
    for d in range(150):
        words = list(base)
        words[rng.randrange(300)] = f"own{d}"
        rows.append((d, " ".join(words)))
    rows += [(1000 + d, " ".join(f"u{rng.randrange(10**6)}" for _ in range(80))) for d in range(20)]
    # alike enough to be tried with the first group, not enough to be linked with it
    for d in range(60):
        words = [f"v{i}" for i in range(36)] + base[36:]
        words[rng.randrange(36, 300)] = f"other{d}"
        rows.append((2000 + d, " ".join(words)))
    monkeypatch.setattr(minhash_forest, "HOT", 40)
    monkeypatch.setattr(minhash_forest, "REGION", 16)
    monkeypatch.setattr(minhash_forest, "BLOCK", 12_000)
    got = {r["doc_id"]: r["component_id"] for r in minhash_forest.near_duplicates(frame(spark, rows), percent=85).collect()}
    assert got == {d: (0 if d < 1000 else d if d < 2000 else 2000) for d, _ in rows}


def test_minhash_forest_chain(spark, monkeypatch):
    """In a group beyond a block, links between its largest part and the rest are found: each document links with the next alone."""
    rows = [(d, " ".join(f"w{i}" for i in range(8 * d, 8 * d + 120))) for d in range(120)]
    want = components_by_force(rows, 85)
    assert {component for _, component in want.values()} == {0}
    monkeypatch.setattr(minhash_forest, "BLOCK_ROWS", 20)
    got = minhash_forest.near_duplicates(frame(spark, rows), percent=85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_minhash_forest_small_beside_large(spark, monkeypatch):
    """Groups within a block keep their links beside a group beyond it, whatever Spark makes of the join that parts them."""
    rows = [(d, " ".join(f"w{i}" for i in range(80)) + f" own{d}") for d in range(30)]
    for d in range(100, 160):
        words = [f"t{d}x{i}" for i in range(80)]
        rows += [(d, " ".join(words)), (d + 1000, " ".join(words[1:]))]
    monkeypatch.setattr(minhash_forest, "BLOCK_ROWS", 20)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["doc_id"]: r["component_id"] for r in minhash_forest.near_duplicates(frame(spark, rows), percent=85).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {d: 0 if d < 30 else d % 1000 for d, _ in rows}


@pytest.mark.parametrize("hot", [5, 10_000])
def test_minhash_forest_boilerplate(spark, monkeypatch, hot):
    """Pairs that share no more of a tree than a very common prefix are found, however many rows share it."""
    rng = np.random.default_rng(5)
    signatures = rng.integers(0, 1 << 32, (300, minhash_forest.TREES, minhash_forest.DEPTH), dtype=np.uint32)
    signatures[:, :, : minhash_forest.SHALLOW] = signatures[0, :, : minhash_forest.SHALLOW]
    signatures[1::2, :, 4:] = signatures[::2, :, 4:]
    monkeypatch.setattr(minhash_forest, "HOT", hot)
    monkeypatch.setattr(minhash_forest, "REGION", 16)
    rows = [(i, x.astype("<u4").tobytes()) for i, x in enumerate(signatures)]
    edges = minhash_forest.loose_edges(spark.createDataFrame(rows, "rep long, signature binary"), 0.85).collect()
    assert {(r["a"], r["b"]) for r in edges} == {(i, i + 1) for i in range(0, 300, 2)}


@pytest.mark.parametrize("percent", [85, 80, 50])
def test_minhash_forest_recall(spark, monkeypatch, percent):
    """Pairs exactly at the threshold are met although boilerplate makes regions over-full, so that they go deeper."""
    rng = np.random.default_rng(percent)
    threshold, n, size = percent / 100, 400, minhash_forest.SIZE
    first = minhash_forest.first_depth(threshold)
    assert first == {85: 3, 80: 3, 50: 2}[percent]
    fresh = lambda: rng.integers(0, 1 << 32, (n, size), dtype=np.uint32)
    one = np.where(rng.random((n, size)) < 0.4, fresh()[0], fresh())
    two = np.where(rng.random((n, size)) < threshold, one, fresh())
    monkeypatch.setattr(minhash_forest, "HOT", 20)
    rows = [(i, x.astype("<u4").tobytes()) for i, x in enumerate(np.concatenate([one, two]))]
    classes = spark.createDataFrame(rows, "rep long, signature binary")
    depths = {r["depth"] for r in minhash_forest.leaves(classes, first).select("depth").distinct().collect()}
    assert len(depths) > 1
    links = minhash_forest.Links(2 * n)
    for r in minhash_forest.loose_edges(classes, threshold).collect():
        links.link(r["a"], r["b"])
    met = sum(links.root(i) == links.root(i + n) for i in range(n)) / n
    assert met >= (0.99 if percent >= 80 else 0.95)


def test_minhash_forest_edges(spark):
    assert minhash_forest.near_duplicates(frame(spark, [])).count() == 0
    got = minhash_forest.near_duplicates(frame(spark, [(None, "a b c"), (7, "A b c"), (8, None), (7, "A b c")])).collect()
    assert sorted((r["component_id"] or 0, r["n_shingles"]) for r in got) == [(7, 1), (7, 1), (7, 1), (8, 0)]


def hits_by_force(rows, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        words = ALNUM.findall((text or "").translate(LOWER))
        size = min(10, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            windows[tuple(words[i : i + size])].add(item)
    out = {}
    for doc, text in rows:
        words = ALNUM.findall((text or "").translate(LOWER))
        hit, met = [False] * len(words), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                found = windows.get(tuple(words[i : i + size]))
                if found:
                    hit[i : i + size] = [True] * size
                    met |= found
        out[doc] = (len(words), sum(hit), sorted(str(x) for x in met if x is not None))
    return out


@pytest.mark.parametrize(("bits", "broadcast"), [(1 << 27, 1 << 19), (64, 0)])
def test_decontamination(spark, monkeypatch, bits, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST", broadcast)
    rows = corpus(5)
    cut = lambda t, a, b: " ".join(t.split()[a:b])
    items = [(1, cut(rows[0][1], 2, 40)), (20, cut(rows[7][1], 0, 12) + " other end"), (3, "two words"), (4, None), (5, ""), (None, "one"), (6, "absent words here"), (7, cut(rows[0][1], 5, 20)), (1, "ñandú ünïcode"), (8, "!!!")]
    benchmark = frame(spark, items, "item_id long, text string")
    found = decontaminate.find_benchmark(with_extras(frame(spark, [*rows, (500, rows[0][1]), (500, rows[0][1])])), benchmark, most_bits=bits)
    got = found.select("doc_id", "n_words", decontaminate.hit_count().alias("n_hit"), "items").collect()
    want = hits_by_force([*rows, (500, rows[0][1])], items)
    assert len(got) == len(rows) + 2
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got} == want
    assert decontaminate.find_benchmark(frame(spark, rows), benchmark.limit(0)).where("size(spans) > 0").count() == 0
    assert decontaminate.find_benchmark(frame(spark, []), benchmark).count() == 0


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    rows = [*corpus(9), (900, "word " * 2500), (901, "an <|endoftext|> inside"), (902, None), (902, "")]
    got = packing.pack(with_extras(frame(spark, rows))).collect()
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
    for doc, text in rows[:-2]:
        ids = np.array([*slow.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        mine = sorted(pieces[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine)))
        assert sum(r["length"] for r in mine) == len(ids) and all(r["length"] == 1024 for r in mine[1:]) and mine[0]["length"] <= 1024
        for r in mine:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    assert len(pieces[902]) == 2
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    total = sum(r["length"] for r in got)
    assert len(sequences) <= total / 1024 * 1.2 + 1
    assert packing.pack(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(1025, np.int64)
    shape = (rng.integers(1, 1025, 3000), rng.integers(1, 200, 3000), rng.integers(340, 345, 500), rng.integers(500, 700, 2000), np.array([1024, 1, 512]), np.array([], int))[seed]
    np.add.at(counts, shape, 1)
    runs = packing.plan(counts, 1024)
    used = np.zeros(1025, np.int64)
    for lengths, times in runs:
        assert sum(lengths) <= 1024 and times > 0
        np.add.at(used, lengths, times)
    assert (used == counts).all()
    bins = sum(t for _, t in runs)
    best: list[int] = []  # best-fit decreasing, one piece at a time
    for v in sorted(shape.tolist(), reverse=True):
        fit = [i for i, room in enumerate(best) if room >= v]
        if fit:
            i = min(fit, key=lambda i: best[i])
            best[i] -= v
        else:
            best.append(1024 - v)
    assert bins <= len(best) * 1.02 + 1


def losses_by_force(rows, target) -> dict[int, tuple[int, float, float]]:
    fold = lambda t: (t or "").translate(LOWER)
    both = {False: [fold(t) for _, t in rows], True: [fold(t) for t in target]}
    characters = {c for texts in both.values() for t in texts for c in t}
    want = {}
    models = {}
    for side, texts in both.items():
        one, four, three = collections.Counter(), collections.Counter(), collections.Counter()
        for t in texts:
            one.update(t)
            for i in range(len(t) - 3):
                four[t[i : i + 4]] += 1
                three[t[i : i + 3]] += 1
        models[side] = (one, sum(one.values()), four, three)
    for doc, text in rows:
        t = fold(text)
        n = max(len(t) - 3, 0)
        loss = []
        for one, size, four, three in (models[True], models[False]):
            total = 0.0
            for i in range(n):
                p1 = (one[t[i + 3]] + 1) / (size + len(characters))
                total -= np.log2((four[t[i : i + 4]] + 10 * p1) / (three[t[i : i + 3]] + 10))
            loss.append(total / n if n else 0.0)
        want[doc] = (n, *loss)
    return want


def test_lm_score_matches_a_plain_model(spark, monkeypatch):
    monkeypatch.setattr(packed, "CHUNK_BYTES", 700)
    rows, target = corpus(13), ["abc def ghi", "jab cde", None, "the zebra"]
    want = losses_by_force(rows, target)
    df = frame(spark, [(t,) for t in target], "text string")
    got = lm_score.score_difference(with_extras(frame(spark, rows)), df).collect()
    assert len(got) == len(rows)
    for r in got:
        n, a, b = want[r["doc_id"]]
        assert r["n_tokens"] == n
        assert np.allclose((r["loss_target"], r["loss_background"], r["score"]), (a, b, a - b))
    assert lm_score.score_difference(frame(spark, []), df).count() == 0
    assert lm_score.score_difference(frame(spark, rows), df.limit(0)).count() == len(rows)


def test_lm_score_of_many_characters(spark, monkeypatch):
    """More characters than 16 bits tell apart: each keeps its own counts."""
    monkeypatch.setattr(packed, "CHUNK_BYTES", 100_000)
    rng = random.Random(4)
    letters = [chr(0x10000 + i) for i in range(70_000)]
    texts = ["".join(rng.sample(letters, len(letters)))]
    for _ in range(20):
        text = texts[0][rng.randrange(60_000) :][:500]
        texts.append(text + "".join(rng.choice(letters[:5] + letters[-5:]) for _ in range(500)) + text[:250])
    rows, target = list(enumerate(texts)), [texts[3][:700], texts[0][:300] + letters[-1] * 9]
    want = losses_by_force(rows, target)
    got = lm_score.score_difference(frame(spark, rows), frame(spark, [(t,) for t in target], "text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        n, a, b = want[r["doc_id"]]
        assert r["n_tokens"] == n
        assert np.allclose((r["loss_target"], r["loss_background"], r["score"]), (a, b, a - b))


def test_language_id(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    parts = {"aa": ["ka", "ro", "mi", "ta"], "bb": ["sch", "ung", "ein", "er"], "cc": ["ção", "nh", "lh", "es"]}
    text = lambda lang: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(40))
    rows = [(i, text(lang), lang) for i, lang in enumerate(list(parts) * 40)] + [(500, None, "aa"), (501, "123 !!", "aa"), (502, "", None), (503, text("bb"), None)]
    df = frame(spark, rows, "doc_id long, text string, lang string")
    model = language_id.fit_filters(df, F.col("doc_id") % 5 != 0, per_language=30)
    got = {r["doc_id"]: r for r in language_id.identify(with_extras(df), model).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:120])
    assert [got[i]["lang_pred"] for i in (500, 501, 502, 503)] == ["und", "und", "und", "bb"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[500]["score"] == 0
    assert language_id.fit_filters(df.limit(0), F.lit(True)) is None
    assert {r["lang_pred"] for r in language_id.identify(df, None).collect()} == {"und"}
    assert language_id.identify(df.limit(0), model).count() == 0
    # the filters answer with every language that holds a gram
    keys = language_id.grams(np.frombuffer(b"karomi", np.uint8), np.array([0, 6]), 3)[0]
    assert len(keys) == 4


def test_language_votes_by_force(spark):
    """Predictions and scores against a plain computation of the filters, with more languages than a mask word holds."""
    from pyspark.sql import functions as F

    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéñ"
    parts = {f"l{k:03d}": ["".join(rng.choice(letters) for _ in range(2)) for _ in range(6)] for k in range(70)}
    text = lambda lang: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(30))
    rows = [(i, text(lang), lang) for i, lang in enumerate(sorted(parts) * 4)]
    asked = [(1000 + i, text(lang), None) for i, lang in enumerate(sorted(parts))] + [(2000, "Zwei,  drei! ABC", None), (2001, "x", None), (2002, "7 8", None)]
    df = frame(spark, [*rows, *asked], "doc_id long, text string, lang string")
    model = language_id.fit_filters(df, F.lit(True), top=40, bits=12)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(df, model).collect()}

    word = (1 << 64) - 1

    def mixed(h):
        h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & word
        h = (h ^ (h >> 27)) * 0x94D049BB133111EB & word
        return h ^ (h >> 31)

    def grams(t):
        plain = re.sub(rb" +", b" ", re.sub(rb"[^a-z\x80-\xff]", b" ", t.translate(LOWER).encode()))
        return [mixed(int.from_bytes(plain[i : i + 3], "big")) for i in range(len(plain) - 2)]

    slots = lambda key: [(key + i * ((key >> 32) | 1) & word) % 4096 for i in range(3)]
    filters = {}
    for lang in sorted(parts):
        counts = collections.Counter(g for _, t, own in rows if own == lang for g in grams(t))
        filters[lang] = {s for g in sorted(counts, key=lambda g: (-counts[g], g))[:40] for s in slots(g)}
    for doc, t, _ in [*rows, *asked]:
        if not re.search(r"[^\W\d_]", t):
            assert got[doc] == ("und", 0.0)
            continue
        own = grams(t)
        votes = {}
        for lang, have in filters.items():
            rate = (len(have) / 4096) ** 3
            votes[lang] = max((sum(all(s in have for s in slots(g)) for g in own) - len(own) * rate) / (1 - rate), 0.0)
        total = sum(votes.values())
        best = max(sorted(votes), key=lambda k: votes[k]) if total else sorted(parts)[0]
        assert got[doc][0] == best and np.isclose(got[doc][1], votes[best] / total if total else 0.0)
    assert sum(got[1000 + i][0] == lang for i, lang in enumerate(sorted(parts))) >= 65


def test_maximal_segments():
    def by_force(scores):
        """Maximal segments by their definition: best contiguous run, then the same left and right of it."""
        if not scores or max(scores) <= 0:
            return []
        best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
        total, _, _, i, j = best
        shift = [(a + j, b + j, s) for a, b, s in by_force(scores[j:])]
        return [*by_force(scores[:i]), (i, j, total), *shift]

    rng = random.Random(4)
    for _ in range(200):
        scores = [rng.choice([-5, -3, -2, -1, 1, 2, 4]) + rng.random() / 100 for _ in range(rng.randrange(0, 12))]
        got, want = toxicity.maximal_segments(scores), by_force(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for _, _, s in got], [s for _, _, s in want])


def test_toxicity_first_words():
    """A text's segments do not depend on the text before it; a repeat within a text still counts as none."""
    import pyarrow as pa

    key = textkit.Words(*textkit.utf8(pa.array(["vile"])), textkit.ALNUM).hashes(True)
    model = toxicity.SegmentModel(key, np.array([2.0]), 0.5, 1.0, 0.0, np.zeros(3))
    texts = ["vile", "vile", "", "vile vile", None, "so vile", "vile"]
    found = toxicity.segments(model, *textkit.utf8(pa.array(texts)))[1]
    assert found == [toxicity.segments(model, *textkit.utf8(pa.array([t], pa.string())))[1][0] for t in texts]
    assert found[0] == found[1] == found[3] == [(0, 1, 2.0)]


def test_toxicity(spark):
    from pyspark.sql import functions as F

    rng = random.Random(6)
    plain, bad = [f"word{i}" for i in range(60)], ["vile", "awful", "nasty"]
    text = lambda toxic: " ".join([rng.choice(plain) for _ in range(30)] + ([rng.choice(bad) for _ in range(3)] if toxic else []) + [rng.choice(plain) for _ in range(30)])
    rows = [(i, text(i % 4 == 0)) for i in range(300)] + [(900, None), (901, ""), (902, "!!"), (None, text(True))]
    docs = frame(spark, rows)
    labels = frame(spark, [(i, int(i % 4 == 0)) for i in range(300)] + [(5, None), (8, 0), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit_labels(docs, labels, F.col("doc_id") % 5 != 0)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(with_extras(docs), model).collect()}
    assert all(got[i]["predicted"] == int(i % 4 == 0) for i in range(300))
    assert got[None]["predicted"] == 1 and all(got[i]["predicted"] == 0 and not got[i]["passages"] for i in (900, 901, 902))
    passage = got[0]["passages"][0]
    assert passage["first_word"] >= 30 and passage["end_word"] <= 33 and passage["e_value"] <= 0.05
    none = toxicity.fit_labels(docs, labels.where("toxic = 0"), F.lit(True))
    assert none is None and {r["score"] for r in toxicity.score_toxicity(docs, none).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0
