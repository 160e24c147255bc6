"""WARC salvage, phrase mining and spelling variants against plain Python versions."""

import collections
import glob
import os
import random
import re
import tempfile
import time
import zlib

import numpy as np
import pytest
from conftest_helpers import prose

from sentrace.llm import collocations, neighbours, spelling, url_filter, warc


def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


# WARC


def pages(session, n=60):
    random.seed(5)
    rows = [(i, f"http://a.org/{i}?q=ä\r\n", prose(i % 7, 300 + 40 * (i % 7)) if i % 3 else f"<p>{i}</p>") for i in range(n)]
    rows += [(None, None, prose(1, 340)), (None, "u", None), (3, "again", "<p>3</p>"), (n, "x", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9)]
    rows.append((n + 1, "y", bytes(random.randrange(32, 127) for _ in range(60_000)).decode() + "WARC/1.0"))
    return session.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' AS payload_digest", "1 AS bytes")


def planned(rows):
    last = {}
    for r in rows:
        body = (r["html"] or "").encode()
        if len(body) >= 1000 and r["page_id"] is not None:
            last[body] = max(last.get(body, -1), r["page_id"])
    many = collections.Counter((r["html"] or "").encode() for r in rows)
    for r in rows:
        body = (r["html"] or "").encode()
        target = last.get(body) if many[body] > 1 else None
        revisit = target is not None and target != r["page_id"]
        yield f"urn:page:{'none' if r['page_id'] is None else r['page_id']}", len(body), f"urn:page:{target}" if revisit else None, b"" if revisit else body


@pytest.mark.parametrize("compressed", [True, False])
def test_archives_come_back(session, compressed):
    df, path = pages(session), folder() + "/a"
    warc.write_archives(df, path, compressed=compressed)
    records, gaps = warc.read_archives(session, path, compressed=compressed)
    mine = [(r["record_id"], r["payload_bytes"], r["refers_to"], bytes(r["bytes"])) for r in records.collect()]
    assert sorted(mine, key=str) == sorted(planned(df.collect()), key=str)
    assert gaps.count() == 0


def test_empty_archives(session):
    records, gaps = warc.round_trip(pages(session).limit(0))
    assert records.count() == 0 and gaps.count() == 0


@pytest.mark.parametrize("compressed", [True, False])
@pytest.mark.parametrize("part_bytes", ["900", "5000", "128m"])
def test_damaged_archives(session, compressed, part_bytes):
    """Every record that is not touched comes back, and gaps and records cover the file."""
    df, path = pages(session).coalesce(1), folder() + "/a"
    warc.write_archives(df, path, compressed=compressed)
    (name,) = glob.glob(path + "/part-*")
    data = bytearray(open(name, "rb").read())
    whole = {}
    at = 0
    if compressed:
        while at < len(data):
            d = zlib.decompressobj(31)
            d.decompress(bytes(data[at:]))
            end = len(data) - len(d.unused_data)
            whole[at] = end
            at = end
    else:
        while at < len(data):
            head = bytes(data[at:]).split(b"\r\n\r\n", 1)[0]
            end = at + len(head) + 8 + int(re.search(rb"Content-Length: (\d+)$", head).group(1))
            whole[at] = end
            at = end
    starts = sorted(whole)
    broken = set(random.Random(1).sample(starts, 6))
    for k, s in enumerate(sorted(broken, reverse=True)):
        middle = (s + whole[s]) // 2
        if k % 3 == 0:
            data[middle if compressed else whole[s] - 8] ^= 0x55
        elif k % 3 == 1:
            del data[middle : whole[s]]
        else:
            data[s : s + 6] = b"\x00garbage\x1f\x8b\x08WARC/1.junk"
    data += data[starts[0] : starts[0] + 40]
    out = folder() + "/b"
    os.mkdir(out)
    with open(out + "/x.warc", "wb") as f:
        f.write(b"junk in front" + bytes(data))
    session.conf.set("spark.sql.files.maxPartitionBytes", part_bytes)
    try:
        records, gaps = warc.read_archives(session, out, compressed=compressed)
        got = [bytes(r["bytes"]) for r in records.collect()]
        lost = sorted((r["at"], r["length"], r["reason"]) for r in gaps.collect())
    finally:
        session.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    intact, _ = warc.read_archives(session, path, compressed=compressed)
    assert len(got) == len(starts) - 6
    assert not collections.Counter(got) - collections.Counter(bytes(r["bytes"]) for r in intact.collect())
    ends = 0
    for at, length, _ in lost:
        assert at >= ends and length > 0
        ends = at + length
    kept = sum(end - s for s, end in whole.items() if s not in broken)
    assert sum(length for _, length, _ in lost) == 13 + len(data) - kept


def test_a_record_with_a_wrong_digest_is_quarantined():
    raw = warc.record_bytes([("WARC-Type", "resource"), ("WARC-Block-Digest", "sha1:" + "A" * 32)], b"abc")
    assert warc.parse_record(raw) == "wrong block digest"
    assert warc.parse_record(raw[:-5]) == "wrong length"
    assert warc.parse_record(b"junk") == "no header"


def test_large_member_ends_in_zero():
    assert warc.member_bytes(np.random.default_rng(0).bytes(17 << 20), 1)[-1] == 0


# Phrases


def phrases_of(rows, min_count, top):
    f = collections.defaultdict(collections.Counter)
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            words = re.findall("[^ \t]+", piece)
            for n in (1, 2, 3):
                f[lang or "und"].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, count in f.items():
        n = sum(v for k, v in count.items() if len(k) == 1)
        big = {k: v for k, v in count.items() if len(k) > 1 and v >= min_count}
        found = []
        for k, a in big.items():
            if len(k) == 2 and any(len(x) == 3 and k in (x[:2], x[1:]) and 100 * v >= 50 * a for x, v in big.items()):
                continue
            score, _, l, r = min((1000000 * a * a // (count[k[:i]] * count[k[i:]]), i, count[k[:i]], count[k[i:]]) for i in range(1, len(k)))
            found.append((-score, -a, " ".join(k).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def mined(df, **options):
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r[n] for n in names) for r in collocations.mine_phrases(df, **options).collect())


@pytest.fixture(scope="module")
def talk(session):
    random.seed(2)
    words = ["New", "york", "is", "not", "Ünï", "sun　x", "a", "b", "the", "\x00z"]
    rows = [(i, " ".join(random.choice(words) + random.choice(["", "", ",", ".\r", "\t"]) for _ in range(random.randrange(60))), random.choice(["en", "de", None])) for i in range(120)]
    rows += [(1, None, "en"), (2, "", None), (None, "new york is big " * 30, "en"), (None, "new york is big " * 30, "en"), (7, "x" * 70000 + " " + "x" * 70000, "en")]
    return session.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS fp", "'c' AS phrase")


@pytest.mark.parametrize("mask", [-1, 0x1F8, 0])
def test_phrases_equal_counting(talk, mask):
    """Also with fingerprints that collide all the time."""
    rows = [(r["text"], r["lang"]) for r in talk.collect()]
    assert mined(talk, min_count=4, top=25, fp_mask=mask) == phrases_of(rows, 4, 25)


def test_no_phrases(talk, odd):
    assert mined(talk.limit(0)) == []
    assert mined(odd, min_count=3) == phrases_of([(r["text"], r["lang"]) for r in odd.collect()], 3, 2000)


def test_long_texts_are_cut_between_pieces(monkeypatch, session, talk):
    data = np.frombuffer(b"aa bb. cc dd, ee ff gg hh ii jj", np.uint8)
    parts = list(collocations.slices(data, np.array([0, 0, len(data), len(data)]), 5))
    assert [bytes(p) for p, _ in parts] == [b"aa bb.", b" cc dd,", b" ee ff gg hh ii jj"]
    assert all(o[0] == 0 and o[-1] == len(p) for p, o in parts)


# Spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(counts):
    best, number = {}, {}
    for w in counts:
        close = [x for x in counts if near(w, x)]
        number[w] = len(close)
        if close:
            form = min(close, key=lambda x: (-counts[x], x))
            if counts[form] >= 2 * counts[w]:
                best[w] = form
    out = []
    for w, n in counts.items():
        root = w
        while root in best:
            root = best[root]
        out.append((w, best.get(w), root, n, number[w], counts[best[w]] if w in best else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=str)


def vocabulary(kind):
    random.seed(3)
    if kind == "dense":
        return {"".join(random.choice("abé") for _ in range(random.randrange(1, 8))): random.randrange(1, 200) for _ in range(500)}
    if kind == "hot":  # all words agree but for the middle
        return {"prefix" + "".join(random.choice("abcdefgh") for _ in range(random.randrange(1, 4))) + "suffix": random.randrange(1, 99) for _ in range(400)}
    long_ = "".join(random.choice("abcdefgh") for _ in range(3000))
    return {w: 2**k for k, w in enumerate([long_, long_ + "x", long_[:1500] + long_[1501:], "y" + long_, long_[:-1] + "ÿ", "aaaaa", "aaaaaa", "aaaaaaa"])}


@pytest.mark.parametrize("kind", ["dense", "hot", "long"])
def test_variants_equal_all_pairs(session, kind):
    counts = vocabulary(kind)
    df = session.createDataFrame(list(counts.items()), "word string, n long").selectExpr("*", "'c' AS root", "1 AS own_word", "2 AS near")
    assert rows_of(spelling.group_variants(df)) == variants(counts)


def test_words_are_counted_with_dropped_letters(session, odd):
    import binascii

    random.seed(4)
    rows = [(i, " ".join(random.choice(["Alpha", "alphà", "beta", "gamma×ray", "delta5epsilon"]) for _ in range(40))) for i in range(60)] + [(None, "Alpha alpha"), (3, None)]
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = binascii.crc32(f"{'' if i is None else i}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run
            counts[word] += len(word) >= 5
    df = session.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS run", "2 AS word", "3 AS h")
    assert {r["word"]: r["n"] for r in spelling.count_words(df).collect()} == {w: n for w, n in counts.items() if n >= 3}
    assert spelling.group_variants(spelling.count_words(odd)).count() > 0
    assert spelling.group_variants(spelling.count_words(odd.limit(0))).count() == 0


def test_words_without_letters(session):
    df = session.createDataFrame([(None, 3), ("", 4), ("ab", 5)], "word string, n long")
    assert rows_of(spelling.group_variants(df)) == sorted([(None, None, None, 3, 0, None), ("", None, "", 4, 0, None), ("ab", None, "ab", 5, 0, None)], key=str)


# Nearest neighbours by inner product


def lengths(kind, n, random_):
    if kind == "unit":
        return np.ones((n, 1))
    if kind == "uniform":
        return random_.uniform(0.5, 2, (n, 1))
    return random_.lognormal(0, float(kind), (n, 1)) * 1e120


@pytest.mark.parametrize("kind", ["unit", "uniform", "0.2", "1.0"])
def test_recall_in_shards_of_the_registered_size(session, kind):
    """Also for vectors of unequal length, and beyond the range of single precision."""
    random_ = np.random.default_rng(11)
    vectors = random_.normal(size=(8000, 48))
    vectors *= lengths(kind, 8000, random_) / np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    frame = session.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8)
    found = {}
    for r in neighbours.nearest(frame).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    queries = np.arange(0, 8000, 20)
    score = vectors[queries] @ vectors.T
    score[np.arange(len(queries)), queries] = -np.inf
    best = np.argsort(-score, axis=1, kind="stable")[:, :20]
    assert sum(len(found[q] & set(b.tolist())) for q, b in zip(queries.tolist(), best)) >= 0.9 * best.size


def test_order_in_double_precision(session):
    rows = [(i, [1.0 + i * 1e-9, 1.0, 2.0]) for i in range(40)]
    got = neighbours.nearest(session.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert [r["vec_id"] for r in got.where("query_id = 0").orderBy("rank").collect()] == list(range(39, 19, -1))


# URL filter


def test_hosts_of_many_labels(session):
    deep = ".".join(["a"] * 20000)
    urls = [f"http://{deep}.example.net/en/x", f"http://{deep}/", "http://net/", "http://x.b..c./p", "http://org", "http://.net/", "http://anet/"]
    pages = session.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string")
    rules = session.createDataFrame(
        [("net", "/", "block"), ("example.net", "/en/", "allow"), ("b..c.", "/", "block"), ("a.a.a", "", "block")], "host string, path string, verdict string"
    )
    began = time.time()
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, rules).collect()}
    assert time.time() - began < 30
    none = (None, "allow")
    assert got == {0: ("example.net/en/", "allow"), 1: ("a.a.a", "block"), 2: ("net/", "block"), 3: ("b..c./", "block"), 4: none, 5: ("net/", "block"), 6: none}
    assert url_filter.filter_urls(pages, rules.limit(0)).where("rule IS NOT NULL").count() == 0
