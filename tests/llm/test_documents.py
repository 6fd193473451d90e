"""Operators on documents against brute force, with odd rows, clashing columns and empty tables."""

import base64
import struct
import tracemalloc

import numpy as np
import plain
import public_tokenizers
import pytest
import tiktoken
from conftest import frame

from seriesmith.llm import blocks, bpe, decontaminate, language_model, licenses, line_dedup, ngram_join, quality, repeats

DOCS = "doc_id long, text string"
REPEATED = [(3, None), (None, "no id here but some words to read"), (None, "no id here but some words to read")]


def ordered(rows):
    return sorted(rows, key=repr)


def test_language_model(spark, texts):
    rows = [*texts, *REPEATED, texts[5], texts[5]]
    got = [(r.id, r.n_words, r.n_backed_off, round(r.log_score, 6)) for r in language_model.score(frame(spark, rows, DOCS)).collect()]
    for g, w in zip(ordered(got), ordered(plain.language_model(rows)), strict=True):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], abs=1e-5)


def test_near_duplicates(spark, texts):
    rows = [*texts, *REPEATED, texts[5]]
    got = [(r.id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(frame(spark, rows, DOCS)).collect()]
    assert ordered(got) == ordered(plain.near_duplicates(rows))


def test_small_sets_link_by_subsets(spark):
    """Sizes around the boundary: sets of 4 to 12 shingles that share all but one or two."""
    w = [f"w{i}" for i in range(30)]
    rows = [(n * 10 + d, " ".join(w[d : d + n])) for n in range(4, 18) for d in range(4)]
    got = [(r.id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(frame(spark, rows, DOCS)).collect()]
    assert ordered(got) == ordered(plain.near_duplicates(rows))
    assert ngram_join.subsets_of(10, 80) > ngram_join.subsets_of(4, 80) > 0
    assert [ngram_join.required(a, b, 80) for a, b in ((5, 5), (4, 5), (9, 9), (10, 10))] == [5, 4, 8, 9]


def test_repeats(spark, texts):
    rows = [*texts[:60], *[t for t in texts if t[0] in (100, 101, 108, -3)], *REPEATED, texts[5], (5, texts[1][1])]
    got = [(r.id, r.n_bytes, r.n_removed, len(r.spans) // 2, bytes(r.kept)) for r in repeats.dedup_repeats(frame(spark, rows, DOCS)).collect()]
    assert ordered(got) == ordered(plain.repeats(rows))


def test_repeats_buckets_get_equal_shares():
    data = np.random.default_rng(1).integers(97, 123, 200_000).astype(np.uint8)
    keys = np.unique(repeats.Contexts(data, np.array([0, len(data)]), 50, 24).key >> np.uint64(24))
    sizes = np.diff(blocks.cuts(keys, 40, 20))
    assert sizes.sum() == len(keys) and sizes.max() < 1.3 * sizes.mean()


def test_repeats_sort_in_bounded_memory():
    """Twice the bytes to sort: the sum of the results grows, not what sorting needs beside them."""
    rng, peaks = np.random.default_rng(2), []
    for n in (1_500_000, 3_000_000):
        data = rng.integers(97, 101, n).astype(np.uint8)
        starts = np.arange(0, n, 3000)
        tracemalloc.start()
        out = repeats.sorted_windows(data, starts, starts + 3000, np.arange(len(starts)).astype(np.uint64), 50)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert len(out[0]) == len(out[1]) == (3000 - 49) * len(starts)
    assert peaks[1] - peaks[0] < 60 * 1_500_000


@pytest.mark.parametrize("together", [1, 2, 1000])
def test_repeats_slices_of_shards(monkeypatch, together):
    """Spans shorter than a window's step, longer ones, and repeats within and between them, in slices of any number of shards."""
    monkeypatch.setattr(repeats, "TOGETHER", together)
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 6000).astype(np.uint8)
    data[3000:4000] = data[500:1500]
    starts, ends = np.array([0, 50, 200, 2500, 2600]), np.array([50, 200, 2500, 2600, 6000])
    keys, low = repeats.sorted_windows(data, starts, ends, np.array([9, 4, 7, 1, 3], np.uint64), 50)
    got = dict(zip(*repeats.grouped(keys, low)[::2], strict=True))
    want = {}
    for a, b, v in zip(starts, ends, (9, 4, 7, 1, 3), strict=True):
        for s in range(a, b - 49):
            w = data[s : s + 50].tobytes()
            want[w] = min(want.get(w, v), v)
    assert sorted(got.values()) == sorted(want.values())


def test_bpe(spark, texts):
    raw = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = [(200 + i, t) for i, t in enumerate(("it's we'll 'S '", "a  b\n\n c \t", "x" * 5000, "中文 12³ 　!", "'́'re're", "<|endoftext|>", " ", "🙂‍"))]
    rows = [*texts, *REPEATED, *odd]
    out = bpe.decode(bpe.encode(frame(spark, rows, DOCS), raw, with_offsets=True), raw).collect()
    want = ordered((i, tuple(enc.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)
    assert ordered((r.id, struct.unpack(f"<{r.n_tokens}I", r.ids), bytes(r.decoded)) for r in out) == want
    for r in filter(lambda r: r.n_tokens, out):  # any run of ids can be cut from the text by the offsets
        at = struct.unpack(f"<{r.n_tokens}I", r.offsets)
        ids = struct.unpack(f"<{r.n_tokens}I", r.ids)
        assert [enc.decode_single_token_bytes(x) for x in ids[:50]] == [bytes(r.decoded)[a:b] for a, b in zip(at, [*at[1:], len(r.decoded)], strict=True)][:50]


def test_quality(spark, texts):
    hosts = ["a", "b", None, "spam"]
    rows = [(i, hosts[k % 3], t) for k, (i, t) in enumerate(texts)] + [(300 + k, "spam", "too short") for k in range(30)]
    rows += [(400, "spam", "a clean text on a host of junk " + " ".join(f"word{i}" for i in range(40))), rows[3], rows[3]]
    got = quality.judge(frame(spark, rows, "doc_id long, source string, text string")).collect()
    want = plain.quality_rules(rows)
    assert ordered((r.id, *[r[c] for c in quality.COUNTS], r.base_failed, r.kept) for r in got) == ordered(want)
    assert {r.id: (r.base_failed, r.kept) for r in got}[400] == (False, False)


def test_decontaminate(spark, texts):
    items = [(1, texts[4][1]), (2, "ONE, two three: four five"), (3, None), (4, "..."), (12, texts[0][1]), (13, texts[0][1])]
    rows = [*texts, *REPEATED, texts[4]]
    bench = frame(spark, items, "item_id long, text string")
    # long matches in one document and not in another, a match that ends with the text, one that repeats itself
    a = texts[0][1].split()
    rows += [(600, "lead in " + " ".join(a[3:40])), (601, " ".join(["same"] * 60)), (602, " ".join(a[5:18]) + " and on " + " ".join(a[5:19]))]
    items.append((14, "same " * 40))
    bench = frame(spark, items, "item_id long, text string")
    want, runs = ordered(plain.decontaminate(rows, items)), ordered(plain.longest_runs(rows, items))
    for block_bytes in (2 << 20, 300):  # one block of items, and several
        got = decontaminate.decontaminate(frame(spark, rows, DOCS), bench, block_bytes=block_bytes).collect()
        assert ordered((r.id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got) == want
        assert ordered((r.id, r.longest_words, r.longest_place) for r in got) == runs
    few = rows[:20]
    longest = decontaminate.longest_matches(frame(spark, few, DOCS), bench).collect()
    assert {(r["item"], r.item_pos): r.n_words for r in longest} == plain.longest_matches(few, items)
    # of all places with a longest match, the smallest id and then the first place
    split = lambda t: plain.ALNUM.findall(plain.lower(t))
    words, docs = {i: split(t) for i, t in items}, [(i, split(t)) for i, t in few]
    for r in longest:
        run = words[r["item"]][r.item_pos : r.item_pos + r.n_words]
        places = [(i is not None, i, p) for i, d in docs for p in range(len(d)) if d[p] == run[0] and d[p : p + len(run)] == run]
        assert (r.id is not None, r.id, r.doc_pos) == min(places, key=lambda x: (x[0], x[1] or 0, x[2]))
    none = decontaminate.decontaminate(frame(spark, rows, DOCS), bench.limit(0)).filter("n_hit > 0 or contaminated or n_items > 0")
    assert none.count() == 0


def test_line_dedup(spark, texts):
    line = "a line of some length that many documents have"
    odd = [(500, line), (501, line + "s"), (502, line[:-1]), (503, line.replace("many", "mony")), (504, "x" + line + "\n" + line), (505, "é" * 3000), (506, "é" * 1500 + "e" + "é" * 1499)]
    rows = [*[r for r in texts if r[0] != 107], *odd, (None, line + "\n" + line)]
    got = [(r.id, r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(frame(spark, rows, DOCS)).collect()]
    assert ordered(got) == ordered(plain.line_dedup(rows))
    twice = [(r.id, r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(frame(spark, [*rows, rows[0]], DOCS)).collect()]
    assert ordered(twice) == ordered([*plain.line_dedup(rows), next(r for r in plain.line_dedup(rows) if r[0] == rows[0][0])])


def test_licenses(spark, texts):
    apache = licenses.TEMPLATES[1][1]
    long = licenses.TEMPLATES[6][1]
    rows = [*[r for r in texts if r[0] not in (107, 108)], (600, apache), (601, "x " * 333 + apache.upper() + " y" * 10), (602, long.replace("sublicense", "SUB")), (603, " ".join(long.split()[:30])), (604, "license")]
    got = {r.id: r.matches for r in licenses.find_licenses(frame(spark, rows, DOCS)).collect()}
    import pyarrow as pa

    from seriesmith.llm import scan

    data, offs = scan.utf8(pa.array([t for _, t in rows], pa.string()))
    _, want = licenses.Scanner(licenses.TEMPLATES).scan_rows(data, offs, exhaustive=True)
    assert {i: [(m.template, m.percent, m.first_word) for m in got[i]] for i, _ in rows} == {i: [(t, *f) for t, f in sorted(x.items())] for (i, _), x in zip(rows, want, strict=True)}
    names = {i: {m.license for m in ms} for i, ms in got.items()}
    assert names[600] == names[601] == {"Apache-2.0"} and names[602] == {"MIT"} and not names[603] and not names[604]
    for c in licenses.Scanner(licenses.TEMPLATES).classes:  # what the bands promise
        assert 1 - (1 - c.similarity**c.rows) ** c.bands >= 0.9999


def test_licenses_of_one_family_are_told_apart(spark):
    notice = ("This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by "
              "the Free Software Foundation, either version {} of the License, or (at your option) any later version.")
    line = "This work is licensed under the GNU {}General Public License, version {}."
    texts = {
        "GPL-2.0": [notice.format("program", ";", "", "2"), line.format("", "2")],
        "GPL-3.0": [notice.format("program", ":", "", "3"), line.format("", "3")],
        "LGPL-2.1": [notice.format("library", ";", "Lesser ", "2.1"), line.format("Lesser ", "2.1")],
        "LGPL-3.0": [notice.format("program", ":", "Lesser ", "3"), line.format("Lesser ", "3")],
        "AGPL-3.0": [notice.format("program", ":", "Affero ", "3"), line.format("Affero ", "3")],
        "GPL-2.0,LGPL-3.0": [notice.format("program", ";", "", "2") + " " + notice.format("program", ":", "Lesser ", "3"), line.format("Lesser ", "3") + " " + line.format("", "2")],
        "BSD-2-Clause": [" ".join(licenses.BSD[:3]) + " This software is provided by the copyright holders and contributors as is"],
        "BSD-3-Clause": [" ".join(licenses.BSD), " ".join(licenses.BSD).replace("copyright holder nor", "University nor")],
        "": ["It is licensed under the GNU General Public License, version of your choice."]}
    rows = [(len(want) * 10 + k, t, want) for want, ts in texts.items() for k, t in enumerate(ts)]
    rows = [(i, t, want) for i, (_, t, want) in enumerate(rows)] + [(900 + i, f"{'before ' * 200}{t} {'after ' * 200}", want) for i, (_, t, want) in enumerate(rows)]
    got = {r.id: ",".join(sorted({m.license for m in r.matches})) for r in licenses.find_licenses(frame(spark, [r[:2] for r in rows], DOCS)).collect()}
    assert got == {i: want for i, _, want in rows}


def test_empty_tables(spark):
    docs = frame(spark, [], "doc_id long, text string, source string")
    raw = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    bench = frame(spark, [(1, "some item")], "item_id long, text string")
    for out in (language_model.score(docs), ngram_join.near_duplicates(docs), repeats.dedup_repeats(docs), bpe.decode(bpe.encode(docs, raw), raw), quality.judge(docs),
                decontaminate.decontaminate(docs, bench), decontaminate.longest_matches(docs, bench), line_dedup.dedup_lines(docs), licenses.find_licenses(docs)):
        assert out.collect() == []
