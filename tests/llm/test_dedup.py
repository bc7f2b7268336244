"""Exact, line, sentence and substring dedup and the n-gram join against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from placelink.llm import exact_dedup, line_dedup, ngram_join, sentence_dedup, suffix_dedup
from tests.llm import data

sha = lambda b: hashlib.sha256(b).hexdigest()
lower = lambda t: (t or "").encode().lower()  # noqa: E731  bytes: A-Z only


def test_exact(spark):
    got = exact_dedup.exact_groups(data.frame(spark)).collect()
    group = collections.defaultdict(list)
    for r in data.rows():
        group[lower(r[1])].append(r[0])
    want = sorted((i, max(g), len(g), hashlib.sha256(t).digest()) for t, g in group.items() for i in g)
    assert sorted((r.doc_id, r.keep_id, r.group_size, bytes(r.digest)) for r in got) == want
    assert sum(r.kept for r in got) == len(group)
    kept = exact_dedup.drop_copies(data.frame(spark))
    assert kept.columns == data.frame(spark).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(max(g) for g in group.values())


def test_exact_index_grows(spark):
    index = exact_dedup.DigestIndex(spark, "index_grows", 2)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    seen = lambda rows: {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in index.groups(rows).collect()}
    a = index.add(frame([(1, "A"), (2, "b"), (None, "c"), (None, "c")]))
    assert seen(a) == {(1, 1, 1, True), (2, 2, 1, True), (None, None, 2, True), (None, None, 2, False)}
    b = index.add(frame([(9, "a"), (8, "d")]))
    assert seen(b) == {(9, 1, 2, False), (8, 8, 1, True)}
    c = index.add(frame([(11, "a"), (12, "A"), (13, "d"), (14, None), (15, "")]))
    assert seen(c) == {(11, 1, 4, False), (12, 1, 4, False), (13, 8, 2, False), (14, 15, 2, False), (15, 15, 2, True)}
    assert seen(a) == {(1, 1, 4, True), (2, 2, 1, True), (None, None, 2, True), (None, None, 2, False)}
    assert index.read().count() == 5
    assert index.add(frame([])).count() == 0
    index.drop()
    assert exact_dedup.exact_groups(frame([])).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index_")]


def lines(rows, min_chars=20, min_docs=3):
    key = lambda x: x.strip(b" \t\n\x0b\f\r").lower()
    held = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").encode().split(b"\n"):
            if len(key(x).decode()) >= min_chars:
                held[key(x)].add(i)
    out = []
    for i, t in rows:
        ls = (t or "").encode().split(b"\n")
        kept = [x for x in ls if len(held.get(key(x), ())) < min_docs or i == max(held[key(x)])]
        out.append((i, len(ls), len(ls) - len(kept), sha(b"\n".join(kept))))
    return sorted(out)


def test_lines(spark):
    got = line_dedup.dedup_lines(data.frame(spark)).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == lines([r[:2] for r in data.rows()])
    assert all(sha(r.kept_text.encode()) == r.kept_sha256 for r in got)
    assert line_dedup.dedup_lines(data.frame(spark).limit(0)).count() == 0


def shingle_set(t, k):
    w = re.findall(rb"[^\x20\x09-\x0D]+", lower(t))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def linked(rows, k, percent):
    s = {i: shingle_set(t, k) for i, t in rows}
    root = {i: i for i in s}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in s:
        for j in s:
            if i < j and s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s[i]), find(i)) for i in s}


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_join(spark, k, percent):
    got = ngram_join.linked_components(data.frame(spark), k, percent).collect()
    want = linked([r[:2] for r in data.rows()], k, percent)
    assert len(got) == len(data.rows())
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_join_chain_of_near_copies(spark, monkeypatch):
    """A group in which neighbours are linked but the ends are not."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 8)
    rng = random.Random(5)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
    rows = []
    for i in range(60):
        words[(5 * i) % 300] = f"v{i}"
        rows.append((i, " ".join(words)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked_components(df).collect()} == linked(rows, 4, 85)
    assert ngram_join.one_of_each(df, 4, 85).columns == ["doc_id", "text"]


def test_one_of_each_by_row(spark):
    near = "these words stand here in two rows"
    rows = [(1, near), (2, near), (2, "another text that no row has"), (None, near), (None, "a text of rows without an id"), (None, "a text of rows without an id"), (4, "twice the same id and text"), (4, "twice the same id and text"), (5, None), (5, "")]
    got = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [rows[0], rows[2], rows[4], rows[6], rows[8], rows[9]]))


@pytest.mark.parametrize("block", [80, 4])
def test_join_counts_links(spark, monkeypatch, block):
    """Every link within groups of near copies is counted, whatever the blocks; equal texts are one set."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    rng = random.Random(6)
    rows = []
    for g in range(3):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
        for i in range(12):
            words[(13 * i) % 200] = f"v{g}.{i}"
            rows.append((len(rows), " ".join(words)))
        rows.append((len(rows), rows[-1][1]))
    rows += [(len(rows), "alone it stands here"), (len(rows) + 1, None)]
    got = {r.doc_id: r.n_links for r in ngram_join.linked_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    s = {i: shingle_set(t, 4) for i, t in rows}
    near = lambda a, b: 100 * len(a & b) >= 85 * len(a | b)
    want = {i: sum(near(a, b) for b in set(s.values()) if a and b and b != a) for i, a in s.items()}
    assert got == want and max(want.values()) > 4


def test_join_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (5, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_join.linked_components(df).collect())
    assert got == [("4", 2, 4), ("5", 0, 5), ("None", 2, 4)]
    assert ngram_join.linked_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("heap", [0, 1 << 12])
def test_divide_skip(monkeypatch, heap):
    monkeypatch.setattr(ngram_join, "HEAP_MOST", heap)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) < p], rng.integers(0, 2**63, 9).astype(np.uint64)])) for p in rng.choice([1, 0.98, 0.95, 0.9, 0.85, 0.5, 0.1], 60)]
    sets += [base[:1], base[:2], base[:1]]
    near = np.array([[100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)) for b in sets] for a in sets])
    links, root = ngram_join.linked_sets(sets, None, 85)
    assert links.tolist() == (near.sum(1) - 1).tolist() and links.max() > 3
    want = np.arange(len(sets))
    for _ in sets:
        want = np.array([want[r].min() for r in near])
    assert root.tolist() == want.tolist()
    for a, b in ((sets, []), ([], sets), ([], None)):
        assert not ngram_join.linked_sets(a, b, 85)[0].any()
    links, _ = ngram_join.linked_sets(sets[:20], sets[20:], 85)
    assert links.tolist() == [*near[:20, 20:].sum(1), *near[20:, :20].sum(1)]


def test_components_of_a_long_path(spark):
    """Far more steps than rounds: a path of 600 nodes in random order, and a star."""
    from placelink.llm.components import components

    rng = random.Random(4)
    names = rng.sample(range(-(10**6), 10**6), 700)
    edges = list(zip(names[:600], names[1:600])) + [(names[600], x) for x in names[601:]]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {x: min(part) for part in (names[:600], names[600:]) for x in part}
    assert {x: got.get(x, x) for x in names} == want


def repeated(rows, width):
    seen = collections.Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        seen.update(b[s : s + width] for s in range(len(b) - width + 1))
    out = []
    for i, b in texts:
        m = bytearray(len(b))
        for s in range(len(b) - width + 1):
            if seen[b[s : s + width]] > 1:
                m[s : s + width] = b"\1" * width
        spans = sum(1 for j in range(len(b)) if m[j] and (j == 0 or not m[j - 1]))
        out.append((i, len(b), sum(m), spans, sha(bytes(x for x, y in zip(b, m) if not y))))
    return sorted(out)


@pytest.mark.parametrize("width,limit,merged", [(200, 1 << 20, 8), (40, 3000, 8), (40, 1000, 2), (40, 500, 1)])
def test_substrings(spark, monkeypatch, width, limit, merged):
    """Whole keys in a shard, keys in several merged shards, keys cut by longer k-grams."""
    monkeypatch.setattr(suffix_dedup, "MERGED", merged)
    monkeypatch.setattr(suffix_dedup, "KEY_BYTES", limit)
    got = suffix_dedup.dedup_substrings(data.frame(spark), width).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == repeated([r[:2] for r in data.rows()], width)


def test_substrings_empty(spark):
    assert suffix_dedup.dedup_substrings(data.frame(spark).limit(0)).count() == 0


def test_suffix_array():
    rng = random.Random(2)
    for n in (0, 1, 2, 9, 100, 700):
        for letters in (b"a", b"ab", b"\0a", b"abcdefgh"):
            t = bytes(rng.choice(letters) for _ in range(n))
            sa = suffix_dedup.suffix_array(np.frombuffer(t, np.uint8))
            assert sa.tolist() == sorted(range(n), key=lambda i: t[i:])
            lcp = suffix_dedup.common_prefixes(np.frombuffer(t, np.uint8), sa)
            for i in range(1, n):
                a, b = t[sa[i] :], t[sa[i - 1] :]
                assert lcp[i] == next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_merge_shards():
    rng = random.Random(3)
    for width in (1, 5, 8, 13, 24):
        a, b = (bytes(rng.choice(b"ab") for _ in range(n)) for n in (60, 80))
        b += a[20:50]
        sa = suffix_dedup.suffix_array(np.frombuffer(b, np.uint8))
        starts = np.arange(len(a) - width + 1)
        got = suffix_dedup.merge_shards(np.frombuffer(a, np.uint8), starts, np.frombuffer(b, np.uint8), sa[sa <= len(b) - width], width)
        assert got.tolist() == [a[s : s + width] in b for s in starts]


def test_sentences(spark):
    rows = [r[:2] for r in data.rows()]
    got = sentence_dedup.dedup_sentences(data.frame(spark)).collect()
    assert len(got) == len(rows)
    passage = [r for r in got if (r.doc_id // 3) % 7 == 3 and r.doc_id // 3 < 40]
    ids = sorted(r.doc_id for r in passage)
    text = dict(rows)
    part = text[ids[0]].split("\n")[-1] if ids[0] // 3 % 5 != 1 else None
    assert all(r.n_removed > 0 for r in passage if r.doc_id != ids[0])
    if part:
        assert sum(part in r.kept_text for r in passage) == 1
    alone = [r for r in got if r.doc_id // 3 in (13, 15, 19, 25)]
    assert all(r.n_removed == 0 and r.kept_text == text[r.doc_id] for r in alone)
    assert {r.n_sentences for r in got if not (text[r.doc_id] or "").strip()} == {0}
    assert sentence_dedup.dedup_sentences(data.frame(spark).limit(0)).count() == 0


def plain_sentences(rows, span=3, min_words=16, long=7, window=7):
    """Sentence spans in plain Python: pieces of words by row, spans as word lists, first by (doc_id, place)."""
    from placelink.llm.vectext import prefix_hash, span_hash

    pieces, spans = {}, collections.defaultdict(set)
    cut = r"[^ \t\n\x0b\f\r.!?,;:\"'()\[\]{}]+"
    for i, t in rows:
        b = (t or "").encode()
        found = [(m.start(), m.end()) for m in re.finditer(cut.encode(), b)]
        if not found:
            pieces[i] = []
            continue
        low = np.frombuffer(lower(t), np.uint8)
        h = span_hash(prefix_hash(low), *np.array(found).T)
        sentences, now = [], []
        for w, (s, e) in enumerate(found):
            now.append(w)
            if w + 1 == len(found) or re.search(rb"[.!?\n]", b[e : found[w + 1][0]]):
                sentences.append(now)
                now = []
        least = {max(range(w, w + window), key=lambda x: (-int(h[x]), x)) for w in range(len(h) - window + 1)}
        out, begins = [], []
        for words in sentences:
            begins.append(len(out))
            piece = []
            for w in words:
                piece.append(w)
                if w == words[-1] or len(words) > long and w in least:
                    out.append(piece)
                    piece = []
        pieces[i] = out
        words = [b[s:e].lower() for s, e in found]
        runs = set(zip(begins, [*begins[span:], len(out)])) if len(begins) >= span else set()
        for a in range(len(out)):
            z = a + span
            while z <= len(out) and sum(map(len, out[a:z])) < min_words:
                z += 1
            if z <= len(out):
                runs.add((a, z))
        for a, z in runs:
            spans[tuple(words[w] for p in out[a:z] for w in p)].add((i, a, z))
    gone = collections.defaultdict(set)
    for places in spans.values():
        first = min((i, a) for i, a, _ in places)
        for i, a, z in places:
            if (i, a) != first:
                gone[i] |= set(range(a, z))
    return {i: (len(p), len(gone[i])) for i, p in pieces.items()}


def test_sentences_equal_plain_python(spark):
    rows = [r[:2] for r in data.rows()[:-2]] + [(1000, "Short one. Two. Three. Four."), (1001, "Zero. short ONE. Two. Three."), (1002, "x"), (1003, "tie " * 40), (1004, "tie " * 40)]
    got = {r.doc_id: (r.n_sentences, r.n_removed) for r in sentence_dedup.dedup_sentences(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == plain_sentences(rows)


def test_sentences_of_rows_without_ids_and_repeated_rows(spark):
    text = "One two three four. Five six seven eight. Nine ten eleven twelve."
    rows = [(None, text), (5, text), (5, text), (4, "Alone here."), (None, None)]
    got = sentence_dedup.dedup_sentences(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("4", 0), ("5", 0), ("5", 0), ("None", 0), ("None", 3)]


def test_lines_and_bytes_of_rows_without_ids(spark):
    line = "this very line stands in several documents here"
    rows = [(None, line), (1, line), (2, line), (3, "x\n" + line), (None, None), (9, "x" * 300), (None, "x" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_dropped) for r in line_dedup.dedup_lines(df).collect())
    assert got == [("1", 1), ("2", 1), ("3", 0), ("9", 0), ("None", 0), ("None", 0), ("None", 0)]
    got = sorted((str(r.doc_id), r.n_removed) for r in suffix_dedup.dedup_substrings(df).collect())
    assert got == [("1", 0), ("2", 0), ("3", 0), ("9", 300), ("None", 0), ("None", 0), ("None", 300)]


def test_short_sentences_are_removed(spark):
    verse = "Red sky at night.\nSailor's delight.\nRed sky at morning.\nSailor's warning."  # three sentences have under 16 words
    rows = [(1, "Nothing else is said here at all.\n" + verse), (2, verse), (3, "One two.\nThree four."), (4, "One two.\nThree four.")]
    got = {r.doc_id: r for r in sentence_dedup.dedup_sentences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_removed == 0 and got[1].kept_text == rows[0][1]
    assert got[2].n_removed == got[2].n_sentences == 4 and got[2].kept_text == ""
    assert got[3].n_removed == got[4].n_removed == 0  # fewer than three sentences


def test_passages_over_50_words_hold_a_span():
    rng = random.Random(8)

    def words(n, stops):
        return "".join(f"w{rng.randint(0, 10**6)}" + (". " if rng.random() < stops else " ") for _ in range(n))

    for _ in range(1500):
        stops = rng.choice([0, 0.02, 0.06, 0.12, 0.3])
        passage = words(51, stops)
        texts = [words(rng.randint(0, 40), stops) + passage + words(rng.randint(0, 40), stops) for _ in range(2)]
        b = np.frombuffer("".join(texts).encode(), np.uint8)
        row, at, to, key = sentence_dedup.spans(b, np.array([0, len(texts[0]), len(b)]))
        assert set(key[row == 0].tolist()) & set(key[row == 1].tolist())


def test_queries_by_turns_in_one_session(spark):
    """Python workers outlive a query: a later one must not read an earlier one's filter."""
    want_lines, want_bytes = lines([r[:2] for r in data.rows()]), repeated([r[:2] for r in data.rows()], 200)
    want_join = linked([r[:2] for r in data.rows()], 4, 85)
    for turn in range(4):
        got = line_dedup.dedup_lines(data.frame(spark), keep_text=False).collect()
        assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == want_lines
        got = suffix_dedup.dedup_substrings(data.frame(spark), keep_text=False).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want_bytes
        if turn % 3 == 0:
            got = ngram_join.linked_components(data.frame(spark)).collect()
            assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want_join
