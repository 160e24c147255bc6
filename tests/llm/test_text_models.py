"""Substring dedup, Jaccard join, packing, neighbours, quality and the pipeline against plain Python."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
from conftest_helpers import prose

import corpus_pipeline
from sentrace.llm import catalog, graph, neighbours, packing, quality, shingle_join, substring_dedup
from sentrace.llm import words as W
from sentrace.storage import materialise


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def copies(seed, n, length):
    """Texts of which some are copies, near copies or share passages."""
    pick = random.Random(seed)
    texts = [prose(seed * 1000 + i, pick.randrange(1, length)) for i in range(n)]
    for i in range(n // 2, n):
        kind, other = pick.randrange(5), texts[pick.randrange(n // 2)]
        if kind == 0:
            texts[i] = other
        elif kind == 1:
            own = split(other)
            own[pick.randrange(len(own))] = "changed"
            texts[i] = " ".join(own)
        elif kind == 2:
            texts[i] += " " + other[: len(other) // 2]
        elif kind == 3:
            texts[i] = other.upper()
    return texts


def test_word_hashes_are_those_of_the_words_alone():
    texts = ["a bb  ccc", "", "bb", "\tccc\n", "x" * 70000 + " a", "y" * 70000 + " a", "\xa0a"]
    data, offsets = W.buffers(pa.array(texts))
    starts, ends, first = W.bounds(data, offsets)
    hashes = W.word_hashes(data, starts, ends)
    found = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    assert found == [w.encode() for t in texts for w in split(t)]
    assert np.diff(first).tolist() == [len(split(t)) for t in texts]
    assert len(set(hashes.tolist())) == len(set(found))
    assert all((hashes[i] == hashes[j]) == (a == b) for i, a in enumerate(found) for j, b in enumerate(found))


def test_window_hashes_tell_windows_apart():
    numbers = np.random.default_rng(1).integers(0, 3, 3000).astype(np.uint64)
    for width in (1, 2, 5, 7, 35):
        got = W.window_hashes(numbers, width)
        plain = [tuple(numbers[i : i + width]) for i in range(len(numbers) - width + 1)]
        assert len(got) == len(plain) and len(set(got.tolist())) == len(set(plain))


def plain_substring_dedup(texts, width):
    where = {}
    for d, t in enumerate(texts):
        w = split(t)
        for s in range(len(w) - width + 1):
            where.setdefault(tuple(w[s : s + width]), []).append((d, s))
    gone = [set() for _ in texts]
    for places in where.values():
        if len(places) > 1:
            for d, s in places:
                gone[d] |= set(range(s, s + width))
    return [" ".join(x for i, x in enumerate(split(t)) if i not in gone[d]) for d, t in enumerate(texts)]


def test_substring_dedup(session, odd, none):
    for width, length in ((4, 30), (35, 200)):
        texts = [*copies(width, 80, length), "", None, "w " * 90]
        docs = session.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
        out = substring_dedup.dedup_substrings(docs, width=width).orderBy("doc_id").collect()
        assert [r["kept"] or "" for r in out] == plain_substring_dedup(texts, width)
        assert [r["n_words"] for r in out] == [len(split(t)) for t in texts]
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    plain = plain_substring_dedup([t for _, t in rows], 35)
    out = substring_dedup.dedup_substrings(odd)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["kept"] or "") for r in out.collect())
    assert got == sorted((i is None, i or 0, p) for (i, _), p in zip(rows, plain))
    assert set(odd.columns) <= set(out.columns)
    assert substring_dedup.dedup_substrings(none).count() == 0


def plain_components(rows):
    """{row number: (set size, smallest id linked)} by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = split(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                label[root(i)] = root(j)
    ids = {}
    for i, (own, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(own)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return [(rows[i][0], len(s), least[root(i)]) for i, s in enumerate(sets)]


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, x or 0) for x in r])


def test_jaccard_join(session, odd, none):
    base = split(prose(42, 60))
    chain = [" ".join(base[: 60 - 2 * k] + [f"new{k}{i}" for i in range(2 * k)]) for k in range(12)]  # links in a row
    texts = [*copies(3, 120, 60), *chain, "", None, "one two", "ONE two", "one"]
    rows = list(enumerate(texts))
    docs = session.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = shingle_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert ordered(map(tuple, got)) == ordered(plain_components(rows))
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    out = shingle_join.near_duplicates(odd)
    got = out.select("doc_id", "n_shingles", "component_id").collect()
    assert ordered(map(tuple, got)) == ordered(plain_components(rows))
    assert out.where("doc_id = 5").select("repeats").distinct().collect() == [(2,)]
    assert shingle_join.near_duplicates(none).count() == 0


def test_divide_skip_counts_what_reaches_the_bound():
    pick = np.random.default_rng(3)
    for _ in range(40):
        query = np.unique(pick.integers(0, 400, 120).astype(np.uint64))
        records = [np.unique(np.append(pick.choice(query, pick.integers(1, 120)), pick.integers(0, 400, pick.integers(0, 60)).astype(np.uint64))) for _ in range(30)]
        found = shingle_join.divide_skip(query, records)
        for r, n in zip(records, found):
            both = len(np.intersect1d(query, r))
            linked = 100 * both >= 80 * (len(query) + len(r) - both)
            assert n == (both if linked else -1)


def test_jaccard_join_of_one_passage_in_small_blocks(session, monkeypatch):
    """Texts around one passage: most share rare shingles without a link, and their group takes many blocks."""
    pick = np.random.default_rng(8)
    base = split(prose(44, 50))
    texts = []
    for i in range(90):
        a, b = sorted(pick.integers(0, 51, 2).tolist())
        own = [f"own{i}x{k}" for k in range(int(pick.integers(0, 25)))]
        texts.append(" ".join([*base[:a], *own, *base[a if i % 2 else b :]]))
    rows = list(enumerate(texts))
    docs = session.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(shingle_join, "BLOCK_SHINGLES", 150)
    got = shingle_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert ordered(map(tuple, got)) == ordered(plain_components(rows))


def test_components_of_long_paths(session):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (95, 90), (95, 99), (7, 7)]
    got = graph.components(session.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r["node"]: r["label"] for r in got} == {**{i: 0 for i in range(1, 41)}, 95: 90, 99: 90, 100: 90}


def test_hilbert_curve_visits_neighbours():
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
        keys = packing.hilbert_keys(grid, bits)
        assert sorted(keys) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def check_packed(pieces, rows, length):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(catalog.tokenizer_path())
    want = {}
    for i, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want.setdefault((i, ids.tobytes()), [0, ids])[0] += 1
    parts = {}
    for p in pieces:
        assert zlib.crc32(bytes(p["ids"])) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"] > 0
        parts.setdefault((p["id"], p["digest"]), []).append(p)
    seen = {}
    for (i, _), own in parts.items():
        own.sort(key=lambda p: p["start"])
        n = sum(p["start"] == 0 for p in own)
        ids = b"".join(bytes(p["ids"]) for p in own) if n == 1 else bytes(own[0]["ids"])
        assert all(p["doc_tokens"] * 4 * n == sum(len(q["ids"]) for q in own) for p in own)
        seen[i, ids] = seen.get((i, ids), 0) + n
    assert seen == {k: n for k, (n, _) in want.items()}
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for own in by_sequence.values():
        own.sort()
        total = sum(n for _, n in own)
        assert [o for o, _ in own] == np.append(0, np.cumsum([n for _, n in own])[:-1]).tolist()
        assert total <= length and total & total - 1 == 0


def test_packing(session, odd, none):
    odd_texts = ["it's <|endoftext|> DON'T\x0bstop now x\x1cy", "É́ é", None, "", " ", "A" * 9000, "İ ß ﬁ 12३ ...!?"]
    texts = [*copies(7, 60, 150), *odd_texts]
    rows = list(enumerate(texts))
    docs = session.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for length in (256, 4096):
        check_packed(packing.pack(docs, catalog.tokenizer_path(), length=length).collect(), rows, length)
    assert packing.pack(none, catalog.tokenizer_path()).count() == 0
    pieces = packing.pack(odd, catalog.tokenizer_path(), with_ids=False)
    whole = sum(p["length"] for p in pieces.collect())
    assert whole == sum(p["doc_tokens"] for p in pieces.where("start = 0").collect())


def test_neighbours(session):
    random_ = np.random.default_rng(5)
    vectors = random_.standard_normal((1500, 24)).astype(np.float32) * random_.uniform(0.5, 2, (1500, 1)).astype(np.float32)
    vectors[700:760] = vectors[700]  # copies
    rows = [(int(i), v.tolist(), "x") for i, v in enumerate(vectors)]
    bad = [(5000, None), (5020, [0.0] * 24), (5040, [float("nan")] * 24), (5060, [float("inf")] + [1.0] * 23), (5080, [None] + [1.0] * 23), (None, [1.0] * 24), (5100, [])]
    odd_rows = [(i, v, "x") for i, v in bad] + [(6000, [1.0, 2.0], "x"), (6001, [2.0, 1.0], "x")] + rows[:40]
    frame = session.createDataFrame(rows + odd_rows, "vec_id long, embedding array<float>, score string").repartition(3)
    got = neighbours.nearest(frame, shard_size=500, query_step=20).collect()
    by_query = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by_query.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert [x for x, _ in by_query.pop(6000)] == [6001]
    assert sorted(by_query) == list(range(0, 1500, 20))
    exact = vectors.astype(float)
    hits = 0
    for q, found in by_query.items():
        score = exact @ exact[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(1500), -score))[:20]
        hits += len(set(best.tolist()) & {v for v, _ in found})
        assert len(found) == 20 and np.allclose([s for _, s in found], [score[v] for v, _ in found], rtol=1e-12)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
    assert hits >= 0.9 * 20 * len(by_query)
    assert neighbours.nearest(frame.limit(0)).count() == 0
    assert neighbours.nearest(session.createDataFrame([(20, [1.0])], "vec_id long, embedding array<float>")).count() == 0


def test_quality(session, odd, none):
    texts = [(i, prose(i, 60) if i % 3 else " | ".join(prose(i, 60).split()) + " ###") for i in range(300)]
    docs = session.createDataFrame(texts, "doc_id long, text string")
    labels = session.createDataFrame([(i, int(bool(i % 3))) for i in range(200)] + [(5, None), (None, 1), (9999, 0)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels, sample=150)
    assert len(model.labels) == 150
    out = {r["doc_id"]: r for r in quality.score_quality(docs, model).collect()}
    assert sum(out[i]["predicted"] == bool(i % 3) for i in range(200, 300)) >= 97
    judged = quality.score_quality(odd, model).collect()
    assert len(judged) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in judged)
    assert quality.score_quality(none, model).count() == 0
    empty = quality.fit_quality(docs, labels.limit(0))
    assert {r["score"] for r in quality.score_quality(docs, empty).collect()} == {0.5}
    counts = quality.trigram_counts(*W.buffers(pa.array([t for _, t in texts[200:230]])))
    unit = model.project(counts)
    cosines = unit @ model.vectors.T
    for row, score in zip(cosines, model.score(counts)):
        near = np.argsort(-row, kind="stable")[: model.neighbours]
        weight = np.maximum(row[near], 0).astype(float) ** 2
        assert abs(score - (weight * model.labels[near]).sum() / weight.sum()) < 1e-6


def test_pipeline(session, tmp_path):
    texts = copies(11, 120, 120)
    leak = prose(900, 40)
    texts += ["12345 !!", None, "", "before " + leak + " after"]
    rows = [(i, t, "en", "s", len(t or ""), 0.25) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double"
    session.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    session.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = session.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(session, docs, str(tmp_path))
        assert out.columns == docs.columns and (name == "line dedup" or out.where("score = 0.25").count() == out.count())
        out.write.parquet(f"{tmp_path}/{number}")
        before, docs = docs, session.read.parquet(f"{tmp_path}/{number}")
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "n-gram Jaccard join":
            plain = plain_components([(r["doc_id"], r["text"]) for r in before.collect()])
            assert set(kept[name]) == {i for i, n, least in plain if n == 0 or i == least}
    assert set(range(len(texts))) - set(kept["language ID"]) == {120, 121, 122}
    assert set(kept["n-gram Jaccard join"]) - set(kept["benchmark decontamination"]) == {123}
    last = corpus_pipeline.STAGES[-1][1](session, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in last} == set(kept["benchmark decontamination"])


def test_parity_bitmaps_differ_in_no_more_bits_than_sets():
    pick = np.random.default_rng(5)
    for n, m in [(1, 1), (60, 70), (129, 128), (250, 300), (1025, 1020), (3000, 2900)]:
        pool = np.unique(pick.integers(0, 1 << 62, n + m, dtype=np.uint64))
        a, b = np.sort(pick.choice(pool, n, replace=False)), np.sort(pick.choice(pool, m, replace=False))
        x, y = shingle_join.parity(a), shingle_join.parity(b)
        size = min(len(x), len(y))
        x, y = (np.bitwise_xor.reduce(z.reshape(-1, size), axis=0) for z in (x, y))
        assert np.unpackbits((x ^ y).view(np.uint8)).sum() <= len(np.setxor1d(a, b))
        assert max(len(shingle_join.parity(a)), len(shingle_join.parity(b))) <= 2 * size


def test_jaccard_join_does_not_pair_a_family_that_does_not_link(session, monkeypatch):
    """60 texts, each with two changed words of its own: any two share about two thirds of their union, so none links."""
    base = split(prose(45, 100))
    texts = []
    for i in range(60):
        words = list(base)
        words[10 + i % 40], words[55 + i % 40] = f"a{i}", f"b{i}"
        texts.append(" ".join(words))
    texts += copies(6, 20, 60)
    rows = list(enumerate(texts))
    docs = session.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = []

    def recorded(df, name, **options):
        out = materialise(df, name, **options)
        if name == "left":
            left.append(out.count())
        return out

    monkeypatch.setattr(shingle_join, "materialise", recorded)
    got = shingle_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert ordered(map(tuple, got)) == ordered(plain_components(rows))
    assert sum(left) <= len(rows)  # 1770 pairs of the family
