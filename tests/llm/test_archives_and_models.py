"""Archives, the toxicity model, suffix arrays, and the whole pipeline."""

import hashlib
import random

import numpy as np
import plain
from conftest import frame
from pyspark.sql import functions as F

from seriesmith.core import scratch_path
from seriesmith.llm import components, lyndon, toxicity, warc

PAGES = "page_id long, url string, html string"
PAYLOAD = "<p>é" + "x" * 200


def page_rows():
    rows = [(i, f"http://a/{i}", PAYLOAD if i % 3 == 0 else f"<p>page {i}" + "y" * i) for i in range(5, 60)]
    return [*rows, (60, None, None), (61, "http://b\r\nX: y", "short"), (62, None, "short"), (None, "http://c", PAYLOAD), (5, "http://d", PAYLOAD), (6, "http://e", PAYLOAD), (6, "http://e", PAYLOAD)]


def expected(rows):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        refers = first.get(b) if first.get(b) != i else None
        out.append((None if i is None else str(i), len(b), plain.sha(b), "revisit" if refers is not None else "response", None if refers is None else str(refers)))
    return sorted(out, key=repr)


def test_archives_round_trip(spark):
    rows = page_rows()
    folder = scratch_path(spark, "warc-test")
    warc.write(frame(spark, rows, PAGES), folder)
    got = warc.read(spark, folder).collect()
    assert sorted(((r.record_id, r.payload_bytes, r.payload_digest, r.type, r.refers_to) for r in got), key=repr) == expected(rows)
    assert all(bytes(r.payload) == PAYLOAD.encode() for r in got if r.type == "response" and r.payload_bytes == len(PAYLOAD.encode()))
    assert {r.uri for r in got if r.record_id == "61"} == {"http://b%0D%0AX: y"}
    small = scratch_path(spark, "warc-small")  # many small files, over what a lost attempt left behind
    warc.write(frame(spark, rows, PAGES).coalesce(1), small, max_bytes=1)
    names = {f.rsplit("/", 1)[1] for f in warc.write(frame(spark, rows, PAGES).coalesce(1), small, max_bytes=2000).toPandas().file}
    again = warc.read(spark, small)
    assert 1 < len(names) < len(rows) and again.select("file").distinct().count() == len(names)
    assert sorted(((r.record_id, r.payload_bytes, r.payload_digest, r.type, r.refers_to) for r in again.collect()), key=repr) == expected(rows)
    empty = scratch_path(spark, "warc-empty")
    warc.write(frame(spark, [], PAGES), empty)
    assert warc.read(spark, empty).collect() == []


def test_salvage_skips_damage_and_logs_it():
    raw = [warc.record("response", str(i), f"http://a/{i}", hashlib.sha256(p).hexdigest(), p, len(p), None) for i, p in enumerate([b"first" * 50, b"second" * 5000, b"third" * 50, b"fourth"])]
    members = [warc.member(r) for r in raw]
    whole = b"".join(members)
    assert [x[3]["record_id"] for x in warc.salvage(whole)] == ["0", "1", "2", "3"]
    broken = bytearray(whole)
    at = len(members[0]) + len(members[1]) // 2
    broken[at : at + 8] = b"\xff" * 8
    got = list(warc.salvage(bytes(broken)))
    assert [x[3]["record_id"] for x in got if x[3]] == ["0", "2", "3"]
    assert [(o, n) for o, n, why, _ in got if why] == [(len(members[0]), len(members[1]))]
    # junk between members, a record out of a member, a wrong digest, a cut end
    wrong = warc.member(warc.record("response", "9", None, "0" * 64, b"payload", 7, None))
    mixed = b"junk" + members[0] + raw[2] + b"\r\n\r\nWARC/1.1 nonsense" + wrong + members[3] + members[1][:-20]
    got = list(warc.salvage(mixed))
    assert [x[3]["record_id"] for x in got if x[3]] == ["0", "2", "3"]
    gaps = [(o, n) for o, n, why, _ in got if why]
    covered = sorted([*gaps, *{(o, n) for o, n, why, _ in got if not why}])
    assert covered[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(covered, covered[1:], strict=False)) and sum(covered[-1]) == len(mixed)
    assert list(warc.salvage(b"")) == []


def test_salvage_recovers_records_inside_a_member():
    """Members of several records: one bad record, a cut end, damage late in the member."""
    rng = random.Random(3)
    load = [bytes(rng.randrange(256) for _ in range(3000)) for _ in range(5)]
    raw = [warc.record("response", str(i), None, hashlib.sha256(p).hexdigest(), p, len(p), None) for i, p in enumerate(load)]
    odd = warc.record("response", "8", None, "0" * 64, raw[3], len(raw[3]), None)  # a wrong digest; its payload looks like a record
    tail = warc.member(raw[4])
    ids = lambda data: [x[3]["record_id"] for x in warc.salvage(data) if x[3]]
    whole = b"".join(raw[:4])
    short = raw[1].replace(b"Content-Length: 30", b"Content-Length: 29")
    for bad in (odd, short, raw[1][:200], raw[1][:1000]):
        one = warc.member(raw[0] + bad + raw[2])
        got = list(warc.salvage(one + tail))
        assert [x[3]["record_id"] for x in got if x[3]] == ["0", "2", "4"]
        assert [(o, n) for o, n, why, _ in got if why] == [(0, len(one))]
        assert f"bytes {len(raw[0])} to {len(raw[0] + bad)} of the inflated member" in next(why for _, _, why, _ in got if why)
    for level in (0, 6):  # stored blocks show the records in the compressed bytes too
        one = warc.member(whole, level)
        assert ids(one + tail) == ["0", "1", "2", "3", "4"]
        cut = one[: len(one) * 5 // 8]
        assert ids(cut) == ["0", "1"] and ids(cut + tail) == ["0", "1", "4"]
        assert sum(n for _, n in {(o, n) for o, n, _, _ in warc.salvage(cut + tail)}) == len(cut + tail)
        late = bytearray(one)
        late[-8] ^= 1  # the check sum
        assert ids(bytes(late) + tail) == ["0", "1", "2", "3", "4"]
        late = bytearray(one)
        late[len(one) * 5 // 8 :] = b"\xff" * (len(one) - len(one) * 5 // 8)
        assert ids(bytes(late) + tail) == ["0", "1", "4"]
    many = [rng.randbytes(3000) for _ in range(100)]
    big = warc.member(b"".join(warc.record("response", str(i), None, hashlib.sha256(p).hexdigest(), p, len(p), None) for i, p in enumerate(many)))  # more than one piece
    assert len(big) > 2 * warc.PIECE and ids(big[:-100] + tail) == [str(i) for i in range(99)] + ["4"]


def test_toxicity_learns_and_ignores_group_mentions(spark):
    rng = random.Random(1)
    plain_words = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(600):
        toxic = rng.random() < 0.3
        w = rng.choices(plain_words, k=20)
        if toxic:
            w[3] = rng.choice(["insulta", "insultb", "insultc"])
            if rng.random() < 0.8:
                w[5] = "muslims"  # the labelled toxic texts name a group
        elif rng.random() < 0.05:
            w[5] = "muslims"
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (902, "Muslims " + " ".join(plain_words[:15])), (903, " ".join(plain_words[:15])), (903, " ".join(plain_words[:15]))]
    docs = frame(spark, rows, "doc_id long, text string")
    lab = frame(spark, [*labels, (1, labels[1][1]), (None, 1), (2, None)], "doc_id long, toxic int")
    scores = {}
    for fairness in (0.0, 50.0):
        model = toxicity.train(toxicity.training_rows(docs, lab), fairness=fairness)
        scores[fairness] = {r.id: r.score for r in toxicity.score(docs, model).collect()}
        hit = [(scores[fairness][i] >= 0.5) == bool(y) for i, y in labels if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
        assert sum(hit) / len(hit) > 0.95
    many = frame(spark, [*rows, *[(1, f"one more text {k}") for k in range(50)]], "doc_id long, text string")
    assert toxicity.training_rows(many, lab).count() == toxicity.training_rows(docs, lab).count() == len({i for i, _ in labels if i != 2 and __import__("zlib").crc32(str(i).encode()) % 5}) + (2 in dict(labels))
    got = scores[50.0]
    assert got[900] == got[901] and 0 <= got[900] < 0.5
    gap = lambda s: abs(np.log(s[902] / (1 - s[902])) - np.log(s[903] / (1 - s[903])))
    assert gap(scores[50.0]) < 0.5 * gap(scores[0.0])
    assert toxicity.score(docs.limit(0), model).collect() == []
    nothing = toxicity.train(toxicity.training_rows(docs, lab.limit(0)))
    assert {round(r.score, 6) for r in toxicity.score(docs, nothing).collect()} == {0.5}


def test_suffix_order():
    rng = random.Random(2)
    for _ in range(60):
        texts = [[ord(rng.choice(a)) for _ in range(rng.randint(0, 25))] + [0] for a in rng.choices(["a", "ab", "abc", "abcdefgh"], k=4)]
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        want = [int(o) + i for t, o in zip(texts, bounds, strict=False) for i in sorted(range(len(t)), key=lambda i: t[i:])]  # noqa: B023
        assert lyndon.suffix_order(np.array(sum(texts, []), np.int64), bounds).tolist() == want


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(50), rng.randrange(50)) for _ in range(30)] + [(200, i) for i in range(201, 260)] + [(7, 7), (None, 3)]
    parent = {x: x for e in edges for x in e if x is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and find(u) != find(v):
            a, b = sorted((find(u), find(v)))
            parent[b] = a
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[x] == find(x) for x in got)
    assert set(got) == {x for u, v in edges for x in (u, v) if u is not None and u != v}


def pipeline_rows(texts):
    """Documents that pass the rules, on one to three lines: copies, copies with an edited word, a benchmark passage; and odd ones."""
    rng = random.Random(11)
    vocabulary = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    fresh = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    bases, rows = [fresh(90) for _ in range(6)], []
    for k in range(40):
        t = rng.choice(bases)
        if k % 4 == 1:
            w = t.split(" ")
            w[rng.randrange(90)] = f"edited{k}"
            t = " ".join(w)
        elif k % 4 == 2:
            t = "\n".join([fresh(30), rng.choice(bases), fresh(20)])
        elif k % 4 == 3:
            t = fresh(60) + (" " + texts[4][1].split("\n")[0] if k % 8 == 3 else "")
        rows.append((k, t, "en", ["a", "b"][k % 2], len(t)))
    return [*rows, *[(i, t, "en", "a", len(t or "")) for i, t in texts if i >= 100], (None, fresh(50), "en", None, 10)]


def test_pipeline_stages(spark, texts, tmp_path):
    import corpus_pipeline as pipeline

    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = pipeline_rows(texts)
    spark.createDataFrame([(1, texts[4][1]), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = frame(spark, [*rows, rows[0]], kind)
    sf = str(tmp_path)
    stage = dict(pipeline.STAGES)
    take = lambda df: [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()]
    now = [*rows, rows[0]]

    got = take(stage["quality rules"](spark, docs, sf))
    kept = [r for r, q in zip(now, plain.quality_rules([(i, s, t) for i, t, _, s, _ in now]), strict=True) if q[-1]]
    assert sorted(got, key=repr) == sorted(kept, key=repr)
    once = list(dict.fromkeys(kept))

    got = take(stage["line dedup"](spark, frame(spark, once, kind), sf))
    lines = plain.line_dedup([(r[0], r[1]) for r in once])
    kept = []
    for r, x in zip(once, lines, strict=True):
        left = r[1] if x[3] and plain.PLAIN.search(x[1]) and len(x[1]) < 0.5 * len(r[1]) else x[1]
        if not x[3] or plain.PLAIN.search(left):
            kept.append((r[0], left, r[2], r[3], len(left)))
    assert sorted(got, key=repr) == sorted(kept, key=repr)

    now = [*kept, kept[1]]
    got = take(stage["n-gram Jaccard join"](spark, frame(spark, now, kind), sf))
    near = plain.near_duplicates([(r[0], r[1]) for r in now])
    kept = list(dict.fromkeys(r for r, x in zip(now, near, strict=True) if x[0] == x[2]))
    assert sorted(got, key=repr) == sorted(kept, key=repr)

    got = take(stage["benchmark decontamination"](spark, frame(spark, kept, kind), sf))
    judged = plain.decontaminate([(r[0], r[1]) for r in kept], [(1, texts[4][1]), (2, None)])
    kept = [r for r, x in zip(kept, judged, strict=True) if not x[-1]]
    assert sorted(got, key=repr) == sorted(kept, key=repr)

    out = stage["byte-level BPE"](spark, frame(spark, [*kept, (900, None, None, None, None)], kind), sf).collect()
    assert sorted((r.doc_id for r in out), key=repr) == sorted([*(r[0] for r in kept), 900], key=repr)
    assert all(r.round_trip and len(r.ids) == 4 * r.n_tokens for r in out)

    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, sf).filter(~F.col("round_trip")).count() == 0
    for _, f in pipeline.STAGES:
        assert f(spark, frame(spark, [], kind), sf).collect() == []


def test_pipeline_near_copies_judges_rows_by_id_and_text(spark):
    """Null and repeated ids: only the linked rows go, and of each linked group exactly one row stays."""
    import corpus_pipeline as pipeline

    rng = random.Random(5)
    fresh = lambda: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(90)}" for _ in range(60))
    a, b, c, d, e = (fresh() for _ in range(5))
    clean = [fresh() for _ in range(3)]
    rows = [(1, a), (None, a + " end"), (None, clean[0]), (None, clean[1]),  # a null-id copy beside clean null-id rows
            (2, b), (3, b + " end"), (3, clean[2]),  # one id with a linked and an unlinked text
            (4, c), (4, c + " end"), (None, d), (None, d + " end"),  # linked rows of one id, and of null ids
            (9, e), (9, e), (None, None), (None, None)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    got = [(r.doc_id, r.text) for r in pipeline.near_copies(spark, frame(spark, [(i, t, "en", "a", 1) for i, t in rows], kind), "").collect()]
    for t in (c, d):  # which of them stays hangs on a hash
        assert len(left := [r for r in got if r[1] in (t, t + " end")]) == 1
        got.remove(left[0])
    assert sorted(got, key=repr) == sorted([(1, a), (None, clean[0]), (None, clean[1]), (2, b), (3, clean[2]), (9, e), (None, None)], key=repr)


def test_pipeline_leaves_no_stub_of_a_copy(spark, tmp_path):
    """Whole copies and near copies with short lines leave no row; the first document of each and the clean ones stay."""
    import corpus_pipeline as pipeline

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8)))
    fresh = lambda: [" ".join(word() for _ in range(rng.randint(12, 30))) if k % 4 else word() for k in range(12)]
    whole, near, clean = fresh(), fresh(), [fresh() for _ in range(4)]
    edited = [x.rsplit(" ", 1)[0] + " " + word() if k % 6 == 1 else x for k, x in enumerate(near)]
    rows = [(1, whole), (2, near), (10, whole), (11, ["", *whole, ""]), (12, edited), *((20 + k, c) for k, c in enumerate(clean))]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, "\n".join(t), "en", "a", 1) for i, t in rows], kind)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "no such passage stands in any document of this test at all so far")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert sorted(r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()) == [1, 2, 20, 21, 22, 23]
