"""Filter audit, whitening and URL filter against brute force, with odd rows, clashing columns and empty tables."""

import math
import random

import numpy as np
import plain
import pytest
from conftest import frame
from pyspark.sql import functions as F

from seriesmith.llm import filter_audit, url_filter, whitening

LABELS = "doc_id long, quality int, toxic int"
DOCS = "doc_id long, source string, text string"
COUNTS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_filter_audit(spark, texts):
    hosts = ["a", "b", None, ""]
    rows = [(i, hosts[k % 4], t) for k, (i, t) in enumerate(texts)] + [(None, "a", texts[0][1]), (None, "a", texts[0][1]), (5, "b", "other text"), (3, "a", None)]
    rows += [rows[4], rows[4], (900, "hot", texts[3][1]), (901, "hot", "é" * 3 + " É A\x0bB # \t" + "Ünï " * 60), (902, "hot", "\x0c\x0b")]
    rows += [(1000 + i, "hot", "the same words on every page of the site") for i in range(40)]
    labels = [(i, i % 2, i % 3 // 2) for i in range(60)] + [(5, 1, 1), (None, 1, 1), (7, None, None), (901, 0, 1)]
    got = [tuple(r[c] for c in COUNTS) for r in filter_audit.audit(frame(spark, rows, DOCS), frame(spark, labels, LABELS)).collect()]
    assert len(got) == len({(r[1] or "") for r in rows}) * 600
    assert sorted(got) == sorted(plain.filter_audit(rows, labels))
    assert filter_audit.audit(frame(spark, [], DOCS), frame(spark, labels, LABELS)).collect() == []
    assert sum(r[6] for r in [tuple(x[c] for c in COUNTS) for x in filter_audit.audit(frame(spark, rows, DOCS), frame(spark, [], LABELS)).collect()]) > 0


def test_word_table_goes_by_bytes(monkeypatch):
    """Equal hashes must not make two words one: with one hash for all, distinct words are still counted right."""
    words = [f"w{i % 37}".encode() for i in range(300)] + [b"x" * 200, b"x" * 199 + b"y"] * 2
    text = np.frombuffer(b" ".join(words), np.uint8)
    offs = np.array([0, 400, len(text)])
    monkeypatch.setattr(filter_audit.scan, "in_row", lambda h, row: np.zeros(len(h), np.uint64))
    got = filter_audit.count_rows(text, offs)["n_distinct"].tolist()
    assert got == [len(set(bytes(text[:400]).split())), len(set(bytes(text[400:]).split()))]


def dense(rows, k):
    """The whitened rows by a dense decomposition, from plain whole numbers."""
    keep = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in keep]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    m = np.array(x, float) - np.array(s) / n
    e, u = np.linalg.eigh(m.T @ m / n)
    e, u = e[::-1], u[:, ::-1]
    use = np.flatnonzero(e[:k] > 1e-10 * e.sum())
    return [i for i, _ in keep], deviation, (m @ u[:, use]) / np.sqrt(e[use]), e[use] / e.sum(), n


def check_whitened(spark, rows, k=32):
    got = whitening.whiten(frame(spark, rows, "vec_id long, embedding array<float>"), k).collect()
    ids, deviation, white, explained, n = dense(rows, k)
    assert len(got) == white.size and all(r.n == n and r.identity_error < 1e-9 for r in got)
    assert sorted((repr(r.vec_id), r.deviation) for r in got if r.component == 1) == sorted((repr(i), d) for i, d in zip(ids, deviation, strict=True))
    for c in range(white.shape[1]):
        mine = [r for r in got if r.component == c + 1]
        assert mine[0].explained == pytest.approx(explained[c], rel=1e-9)
        sign = np.sign(sum(r.whitened * white[ids.index(r.vec_id), c] for r in mine))  # repeated ids have equal vectors here
        for r in mine:
            assert r.whitened * sign == pytest.approx(white[ids.index(r.vec_id), c], abs=1e-7)


def test_whitening(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 60)) * np.linspace(3, 0.2, 60) + 5
    x[:, 0] *= 40
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    rows += [rows[7]] * 100 + [(None, rows[9][1])]
    odd = [(900, None), (901, [None, *rows[0][1][1:]]), (902, [float("nan"), *rows[0][1][1:]]), (903, [float("inf"), *rows[0][1][1:]])]
    check_whitened(spark, rows + odd)


def test_whitening_of_few_or_flat_vectors(spark):
    check_whitened(spark, [(i, [float(i % 3), float(i % 2), 7.0]) for i in range(12)])  # fewer dimensions than components, one of them flat
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).collect() == []
    assert whitening.whiten(frame(spark, [], kind)).collect() == [] and whitening.whiten(frame(spark, [(1, None), (2, [])], kind)).collect() == []
    with pytest.raises(Exception, match="different lengths"):
        whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0])], kind)).collect()
    far = whitening.whiten(frame(spark, [(1, [1e15, 1.0]), (2, [-1e15, 2.0])], kind)).collect()
    assert {r.deviation for r in far} == {None}  # beyond 64 bits


def test_leading_pairs_of_hard_spectra():
    rng = np.random.default_rng(5)
    u = np.linalg.qr(rng.standard_normal((120, 120)))[0]
    for spectrum in (np.r_[1e6, 1e4, np.linspace(60, 50, 118)], np.r_[np.full(40, 9.0), np.full(80, 1.0)], np.r_[np.full(10, 4.0), np.zeros(110)], np.ones(120)):
        v = (u * spectrum) @ u.T
        passes = []
        values, axes = whitening.leading_pairs(lambda q, v=v, passes=passes: (passes.append(1), v @ q)[1], 120, spectrum.sum(), 32)
        assert np.allclose(values, spectrum[:32], rtol=1e-10, atol=1e-9 * spectrum[0]) and len(passes) < 200
        assert np.abs(axes.T @ axes - np.eye(32)).max() < 1e-12 and np.abs(v @ axes - axes * values).max() < 1e-10 * spectrum[0]


URLS = "page_id long, url string"


def test_url_rules(spark):
    rules = url_filter.RULES
    urls = ["http://a.example.org/es/1", "https://Example.ORG/en/12?x=/es/", "http://example.org/en/2", "http://notexample.org/es/", "http://x.com/de/", "x://com/fr/a#/de/",
            "http://x.com?/de/", "http://y.com#/de/", "org/", None, "", "://", "http://net/", "a://b://c/d", "http://ÀB.Com/fr/É", "http://a.org:80/", "http://com./fr/", "http://h.net/" + "a1" * 30000]
    rows = list(enumerate(urls)) + [(None, urls[0]), (0, urls[0])]
    got = url_filter.judge(frame(spark, rows, URLS), trees=3).collect()
    want = [(i, *plain.url_parts(u, rules)[:3]) for i, u in rows]
    assert sorted(map(repr, ((r.id, r.host, r.path, r.rule) for r in got))) == sorted(map(repr, want))
    verdicts = {(r.host, r.path): r.verdict for r in got}
    for _, u in rows:
        host, path, rule, verdict = plain.url_parts(u, rules)
        assert verdicts[host, path] == verdict if rule else verdicts[host, path] in ("allow", "block")


def made_urls(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(3, 9)))
    out = []
    for _ in range(n):
        bad = rng.random() < 0.4
        host = f"{word()}{rng.randint(100, 99999) if bad and rng.random() < 0.8 else ''}.{rng.choice(['biz', 'net'] if bad else ['net', 'edu'])}"
        query = "?" + "&".join(f"{word()}={rng.randint(0, 99)}" for _ in range(rng.randint(2, 5))) if bad and rng.random() < 0.7 else ""
        out.append((f"http://{host}/{'/'.join(word() for _ in range(rng.randint(1, 4)))}{query}", "block" if bad else "allow"))
    return out


def test_url_trees_on_held_out_urls(spark):
    labelled = spark.createDataFrame(made_urls(1500, 1), "url string, verdict string")
    fresh = made_urls(500, 2)
    pages = frame(spark, [(k, u) for k, (u, _) in enumerate(fresh)], URLS)
    got = {r.id: r.verdict for r in url_filter.judge(pages, rules=(), labelled=labelled).collect()}
    right = sum(got[k] == v for k, (_, v) in enumerate(fresh)) / len(fresh)
    assert right > 0.85 > 1.3 * max(sum(v == "allow" for _, v in fresh), sum(v == "block" for _, v in fresh)) / len(fresh)
    few = {r.id: r.verdict for r in url_filter.judge(pages, rules=(), labelled=labelled, max_rows=400).collect()}
    assert sum(few[k] == v for k, (_, v) in enumerate(fresh)) / len(fresh) > 0.8


def test_url_filter_without_labels_or_rows(spark):
    rows = frame(spark, [(1, "http://a.net/x"), (2, None)], URLS)
    assert {r.verdict for r in url_filter.judge(rows).collect()} == {"allow"}
    one = spark.createDataFrame([("http://b.net/", "block")], "url string, verdict string")
    assert {r.verdict for r in url_filter.judge(rows, labelled=one).collect()} == {"block"}
    assert url_filter.judge(frame(spark, [], URLS)).collect() == []


def test_lexical_features(spark):
    row = spark.createDataFrame([("https://a-b.x1.example.co/p/q_r/f.html?k=1&l=%20#z",)], "url string")
    host, path = url_filter.host_and_path(F.col("url"))
    r = url_filter.lexical(row.withColumns({"host": host, "path": path})).first()
    text = r.url
    want = {"n_url": len(text), "n_host": 17, "n_path": 13, "depth": 3, "host_labels": 4, "n_params": 2, "n_query": 9, "n_hyphens": 2, "n_percent": 1, "n_extension": 4,
            "last_segment": 6, "has_fragment": 1, "is_secure": 1, "digit_ratio": sum(c.isdigit() for c in text) / len(text), "host_digit_ratio": 1 / 17,
            "entropy": -sum(text.count(c) / len(text) * math.log2(text.count(c) / len(text)) for c in set(text))}
    assert {k: r[k] for k in want} == pytest.approx(want) and (r.suffix1, r.suffix2) == ("co", "example.co")
