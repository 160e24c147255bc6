"""Licence scan, URL filter, line dedup, decontamination and language ID against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest_helpers import prose

from sentrace.llm import decontamination, language_id, licenses, line_dedup, url_filter


def test_license_scan(session, odd, none):
    texts = [
        (1, "LICENSED under the Apache Licence -- version 2.0"),
        (2, "Copyright (c) 2024 Someone\nReleased under the MIT license!\n\nAll rights reserved."),
        (3, "Some prose.\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License."),
        (4, licenses._MIT.upper()),
        (5, "(c) 2020 nobody"),
        (6, None),
        (6, None),
    ]
    docs = session.createDataFrame([(i, t, "old") for i, t in texts], "doc_id long, text string, license string")
    known = licenses.known_licenses(session)
    got = sorted(map(tuple, licenses.scan_licenses(docs, known).select("doc_id", "license", "notices").collect()))
    assert got == [
        (1, "Apache-2.0", "Apache-2.0"),
        (2, "MIT", "MIT"),
        (3, None, "CC-BY-NC-4.0,MIT"),
        (4, "MIT", ""),
        (5, None, ""),
        (6, None, ""),
        (6, None, ""),
    ]
    assert licenses.scan_licenses(odd, known).count() == odd.count()
    assert licenses.scan_licenses(none, known).count() == 0
    assert licenses.scan_licenses(docs, known.limit(0)).where("license IS NOT NULL").count() == 0


def test_whole_licenses_and_copyright_lines(session):
    """Whole texts beyond MIT and ISC, owners without a year, and years that are no copyright line."""
    folder = licenses.Path(licenses.__file__).parent / "license_texts"
    texts = {path.stem.removesuffix("-regents"): path.read_text() for path in sorted(folder.glob("*.txt"))}
    assert {"BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense", "Zlib", "CC0-1.0", "BSL-1.0"} <= set(texts)
    mit = licenses._MIT.split("\n", 4)[4]
    cases = [(name, "Copyright (c) 2011-2014 Some One\n2015 Another\n\n" + text) for name, text in texts.items()]
    cases += [
        ("MIT", "Copyright Joyent, Inc. and other contributors.\n\n" + mit),
        ("MIT", "The MIT License (MIT)\n© Joyent\n  2001, Else\n2002 More\n" + mit),
        ("MIT", "(c) Joyent, Inc.\nAll rights reserved.\n" + mit),
        (None, "2019 was a good year\n" + mit),
        (None, "Copyright 2018 One\nReleased under the MIT License.\n2019 was a good year"),
        (None, "Copyright infringement is wrong\n" + mit),
        (None, "(c) You must retain it\n" + mit),
        (None, texts["Apache-2.0"].replace("(c) You must retain", "(c) You need not retain")),
        (None, "Copyright (c) 2018 One"),
        (None, "Copyright (c) 2018 One\n" + "2019 x\n" * 20000),
    ]
    docs = session.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    out = licenses.scan_licenses(docs, licenses.known_licenses(session)).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["license"]) for r in out] == [(i, name) for i, (name, _) in enumerate(cases)]


def test_url_filter(session):
    urls = [
        "http://a.EXAMPLE.com/de/x", "https://example.com/de/", "https://example.com/de", "http://b.net/x", "http://b.net",
        "HTTP://m.example.net/en/1?x#y", "http://xexample.net/en/1", "ftp://org/fr/", "http://a.b.org/fr/z#f", "no scheme", None, "",
        "http://", "x://y://example.net/en/", "http://net/", "http://user@example.com:80/de/", "http://b.net/x",
    ]
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("ORG", "/fr/", "allow")]
    odd_rules = [("org", "/fr/", "block"), (None, "/", "block"), ("", "/", "block"), ("com", None, "block")]
    listed = session.createDataFrame(rules + odd_rules, "host string, path string, verdict string")
    pages = session.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")

    def plain(url):
        host = path = ""
        if url is not None and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h.lower() + p, v) for h, p, v in rules if (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, listed).collect()}
    assert got == {i: plain(u) for i, u in enumerate(urls)}
    assert {r["verdict"] for r in url_filter.filter_urls(pages, listed.limit(0)).collect()} == {"allow"}
    assert url_filter.filter_urls(pages.limit(0), listed).count() == 0


def test_bloom_filter_keeps_every_listed_url_of_a_long_list(session):
    listed = session.range(5000).selectExpr("concat('h', id % 97, '.example') AS host", "concat('/p/', id, '/') AS path", "'block' AS verdict")
    pages = session.range(6000).selectExpr("id AS page_id", "concat('http://www.h', id % 97, '.example/p/', id, '/q') AS url")
    got = url_filter.filter_urls(pages, listed)
    assert got.where("verdict = 'block'").count() == 5000
    assert got.where("verdict = 'allow' AND page_id >= 5000").count() == 1000


def plain_line_dedup(rows, width):
    """Remaining texts of (order, text) rows: every window of filled lines against all earlier ones."""
    seen, out = set(), []
    for text in rows:
        lines = text.split("\n")
        full = [i for i, line in enumerate(lines) if line.strip(" ")]
        gone = set()
        for s in range(len(full) - width + 1):
            run = tuple(lines[i] for i in full[s : s + width])
            if run in seen:
                gone |= set(full[s : s + width])
            seen.add(run)
        out.append("\n".join(line for i, line in enumerate(lines) if i not in gone))
    return out


@pytest.mark.parametrize("width", [1, 3])
def test_line_dedup(session, odd, none, width):
    pick = random.Random(width)
    texts = ["\n".join(pick.choice(["a", "b", "c", "", " ", "dd"]) for _ in range(pick.randrange(14))) for _ in range(60)]
    docs = session.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = [r["text"] for r in line_dedup.dedup_lines(docs, min_lines=width).orderBy("doc_id").collect()]
    assert got == plain_line_dedup(texts, width)
    out = line_dedup.dedup_lines(odd, min_lines=width)
    assert out.count() == odd.count() and out.where("doc_id = 1 AND text IS NULL AND n_lines = 0").count() == 1
    assert out.where("doc_id = 5").select("text").distinct().count() == 1  # repeated rows are one document
    assert line_dedup.dedup_lines(none, min_lines=width).count() == 0


def test_line_dedup_finds_long_runs_of_one_or_two_lines(session):
    pick = random.Random(8)
    pool = ["a", "bb ", " c c", "", " ", "d" * 6, "e" * 7, "f" * 12, "g h" * 5]
    texts = ["\n".join(pick.choice(pool) for _ in range(pick.randrange(7))) for _ in range(60)]
    seen, plain = set(), []
    for text in texts:
        lines = text.split("\n")
        full = [i for i, line in enumerate(lines) if line.strip(" ")]
        gone = set()
        for n in (1, 2, 3):
            for s in range(len(full) - n + 1):
                run = tuple(lines[i] for i in full[s : s + n])
                if n == 3 or sum(len(x.strip(" ")) for x in run) >= 10:
                    gone |= set(full[s : s + n]) if run in seen else set()
                    seen.add(run)
        plain.append("\n".join(line for i, line in enumerate(lines) if i not in gone))
    docs = session.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    out = line_dedup.dedup_lines(docs, min_chars=10).orderBy("doc_id").collect()
    assert [r["text"] for r in out] == plain


def edit_distance_in(text, pattern):
    """Least edit distance of ``pattern`` to any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_decontamination(session, odd, none):
    pick = random.Random(5)
    items = [(i, prose(100 + i, pick.randrange(8, 60))) for i in range(12)] + [(50, None), (51, ""), (None, prose(9, 40)), (52, "short one")]
    benchmark = session.createDataFrame(items, "item_id long, text string")
    rows, planted = [], {}
    for d in range(60):
        text = prose(1000 + d, pick.randrange(5, 150))
        if d % 2:
            item = d % 12
            body = list(items[item][1])
            for _ in range(int(len(body) * 0.04) if d % 4 == 1 else 0):
                at = pick.randrange(len(body))
                body[at : at + pick.randrange(2)] = pick.choice("xyz")
            text = text + "\n" + "".join(body).upper() + "! " + prose(2000 + d, 20)
            planted[d] = item
        rows.append((d, text))
    docs = session.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for block in (decontamination.BLOCK_BYTES, 500):  # in one pass and in several
        found = decontamination.find_leaks(docs, benchmark, block_bytes=block)
        got = {r["doc_id"]: {x["item_id"] for x in r["leaks"]} for r in found.collect()}
        assert all(item in got[d] for d, item in planted.items())
        assert all(not got[d] for d, _ in rows if d not in planted)
    out = decontamination.find_leaks(odd, benchmark)
    assert out.count() == odd.count() and dict(out.dtypes)["leaks"].startswith("array")
    assert decontamination.find_leaks(none, benchmark).count() == 0
    assert decontamination.find_leaks(docs, benchmark.limit(0)).where("size(leaks) > 0").count() == 0


def test_alignment_equals_the_full_table():
    pick = random.Random(8)
    pattern = prose(77, 12).replace("\n", " ")
    index = decontamination.build_index([1], [pattern])
    codes = "".join(map(chr, index.codes[0, : index.lengths[0]]))
    for _ in range(20):
        body = list(codes)
        for _ in range(pick.randrange(6)):
            at = pick.randrange(len(body))
            body[at : at + pick.randrange(2)] = pick.choice("xyz")
        text = prose(pick.random(), 9) + " " + "".join(body) + " " + prose(pick.random(), 9)
        leaks = decontamination.leaks_of(index, [text])[0]
        plain = "".join(map(chr, decontamination.normal([text])[0][1:]))
        best = min(edit_distance_in(plain, "".join(map(chr, index.codes[s, : index.lengths[s]]))) for s in range(len(index.items)))
        if best <= index.budgets.min():
            assert [x["distance"] for x in leaks] == [best]


def plain_kneser_ney(texts_by_lang, text, order):
    """Bits per character of ``text`` in each language, by dictionaries."""

    def normal(t):
        t = re.sub(r"[^a-zA-Z]+", " ", t).lower()
        return " " * (order - 1) + t.lstrip(" ")

    grams = {lang: Counter() for lang in texts_by_lang}
    for lang, texts in texts_by_lang.items():
        for t in texts:
            s = normal(t)
            grams[lang].update(s[i - order + 1 : i + 1] for i in range(order - 1, len(s)))
    alphabet = {g[-1] for c in grams.values() for g in c}
    out = {}
    for lang, top in grams.items():
        counts = {order: top}
        for n in range(order - 1, 0, -1):
            counts[n] = Counter(g[1:] for g in counts[n + 1])
        totals, kinds, discount = {}, {}, {}
        for n, c in counts.items():
            totals[n], kinds[n] = Counter(), Counter()
            for g, k in c.items():
                totals[n][g[:-1]] += k
                kinds[n][g[:-1]] += 1
            once, twice = sum(k == 1 for k in c.values()), sum(k == 2 for k in c.values())
            discount[n] = once / (once + 2 * twice) if once else 0.5

        def p(g):
            n = len(g)
            if n == 0:
                return 1 / (len(alphabet) + 1)
            total = totals[n][g[:-1]]
            if not total:
                return p(g[1:])
            return max(counts[n][g] - discount[n], 0) / total + discount[n] * kinds[n][g[:-1]] / total * p(g[1:])

        s = normal(text)
        bits = [-math.log2(p(s[i - order + 1 : i + 1])) for i in range(order - 1, len(s))]
        out[lang] = sum(bits) / len(bits)
    return out


def test_language_models_equal_plain_kneser_ney(session):
    texts = {"aa": [prose(i, 40) for i in range(6)], "bb": [prose(i, 30)[::-1] for i in range(20, 25)]}
    rows = [(t, lang) for lang, own in texts.items() for t in own] + [(None, "aa"), ("x", None)]
    models = language_id.fit_languages(session.createDataFrame(rows, "text string, lang string").repartition(3))
    assert models.langs == ["aa", "bb"]
    for text in (prose(50, 20), prose(51, 9)[::-1], "Qqq wholly unseen xyzzy", "k"):
        bits, _, _ = language_id.cross_entropies(models, [text])
        plain = plain_kneser_ney(texts, text, language_id.ORDER)
        assert np.allclose(bits[0], [plain["aa"], plain["bb"]], rtol=1e-4)


def test_language_id(session, odd, none):
    rows = [(prose(i, 60), "aa") for i in range(20)] + [(prose(i, 60)[::-1], "bb") for i in range(20, 40)]
    models = language_id.fit_languages(session.createDataFrame(rows, "text string, lang string"))
    texts = [(i, prose(100 + i, 5 + i) if i % 2 else prose(100 + i, 5 + i)[::-1]) for i in range(40)]
    got = language_id.identify(session.createDataFrame(texts, "doc_id long, text string"), models).collect()
    right = sum(r["lang_pred"] == ("aa" if r["doc_id"] % 2 else "bb") and not r["rejected"] for r in got)
    assert right >= 39
    out = {(r["doc_id"], r["text"]): r for r in language_id.identify(odd, models).collect()}
    assert len(out) >= 16
    for key in ((1, None), (2, ""), (13, "123 456 !!")):
        assert out[key]["lang_pred"] == "und" and out[key]["score"] == 0 and out[key]["rejected"] and out[key]["bits"] is None
    foreign = session.createDataFrame([(1, "Совсем другой язык, которого модель не видела никогда раньше")], "doc_id long, text string")
    assert language_id.identify(foreign, models).first()["rejected"]
    assert language_id.identify(none, models).count() == 0
    nothing = language_id.fit_languages(none)
    judged = language_id.identify(odd, nothing)
    assert judged.where("lang_pred != 'und'").count() == 0
    assert judged.where("rejected").count() == odd.where("text IS NULL OR NOT text RLIKE '[a-zA-Z]'").count()


def test_language_models_keep_all_sequences_in_small_blocks(session):
    """A rare language and sequences of count 1 stay when there are more sequences than a block has rows."""
    texts = {"hot": [prose(i, 60) for i in range(4)] * 5, "low": ["ŵyth ŷd gŵr", "tŷ"]}
    docs = session.createDataFrame([(t, lang) for lang, own in texts.items() for t in own], "text string, lang string")
    whole = language_id.fit_languages(docs)
    cut = language_id.fit_languages(docs, max_sequences=40)
    assert cut.langs == ["hot", "low"] and len(whole.blocks) == 1 and len(cut.blocks) > 5
    asked = [prose(70, 30), "gŵr ŷd", "unseen qqq", "k", "", None]
    bits, _, _ = language_id.cross_entropies(cut, asked)
    assert np.allclose(bits, language_id.cross_entropies(whole, asked)[0], rtol=1e-6)
    assert np.allclose(cut.mean, whole.mean) and np.allclose(cut.deviation, whole.deviation)
    rows = [(i, t) for i, t in enumerate(asked)]
    got = {}
    for models in (whole, cut):
        out = language_id.identify(session.createDataFrame(rows, "doc_id long, text string").repartition(3), models)
        got[len(models.blocks)] = sorted((r["doc_id"], r["lang_pred"], r["rejected"]) for r in out.collect())
    assert got[1] == got[len(cut.blocks)] and (1, "low", False) in got[1]


def test_hash_array():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 40, 5000).astype(np.uint64))
    array = language_id.HashArray(keys, 2)
    assert (keys[array.order_of[array.find(keys)]] == keys).all()
    assert (array.find(keys + np.uint64(1 << 41)) == -1).all()
    assert (language_id.HashArray(keys[:0], 1).find(keys) == -1).all()
