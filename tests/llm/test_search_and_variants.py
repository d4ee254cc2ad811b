"""Operators 11 to 13 on small fixtures: brute force, nulls, empty and very long texts,
ties, repeated rows, empty tables, and extra columns with clashing names."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from riskgate.llm import chosen_path, lexical_search, spelling_variants
from tests.llm.test_small_cases import brute_components

DOCS = ("doc_id long, text string, word string, node string, cls string, score string, rank string, item string, "
        "n long, form string, component_id string")
RULE = chosen_path.Near(words=5, percent=85)


def documents(spark, rows):
    """Rows with extra columns named like the operators' own."""
    return spark.createDataFrame([(i, t, *"abcdef", 7, "g", "h") for i, t in rows], DOCS)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# -- spelling variants -----------------------------------------------------------

def brute_variants(rows):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    by = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, others in by.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, n[w], len(by[w]), form[w], None if form[w] is None else n[form[w]], root))
    return out


def variant_rows(df):
    return {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def variant_texts(seed, alphabet, rows):
    draw = random.Random(seed)
    base = ["".join(draw.choice(alphabet) for _ in range(draw.randint(4, 9))) for _ in range(60)]

    def word():
        w = draw.choice(base)
        for _ in range(draw.choice([0, 0, 1, 2])):
            k = draw.randrange(len(w) + 1)
            w = draw.choice([w[:k] + draw.choice(alphabet) + w[k:], w[:k] + w[k + 1:], w[:k] + draw.choice(alphabet) + w[k + 1:]])
        return w.title() if draw.random() < 0.2 else w

    return [(i, " ".join(word() + draw.choice(["", ",", "2", "\n", "中"]) for _ in range(80))) for i in range(rows)]


@pytest.mark.parametrize("alphabet", ["ab", "abcdeéÿ×", "abcdefghijklmnop"])
def test_variants_equal_brute_force(spark, alphabet):
    rows = variant_texts(len(alphabet), alphabet, 120)
    want = brute_variants(rows)
    assert len(want) > 40 and any(r[3] for r in want)
    assert variant_rows(spelling_variants.spelling_variants(documents(spark, rows))) == want


def test_large_lists_are_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling_variants, "BLOCK", 16)
    rows = variant_texts(1, "ab", 150)
    assert variant_rows(spelling_variants.spelling_variants(documents(spark, rows))) == brute_variants(rows)


def test_variant_edge_cases(spark):
    long = "x" * 70_000
    rows = [(1, None), (2, ""), (3, " 12 \n"), (4, f"{long} {long}y {long} {long}y {long}"), (4, f"{long}y Ärger"), (None, "ärger ärger Ärger"),
            (5, "house house house hause hause hause houses houses houses"), (5, "house house house")]
    got = variant_rows(spelling_variants.spelling_variants(documents(spark, rows)))
    assert got == brute_variants(rows)
    assert ("hause", 3, 1, "house", 6, "house") in got and any(len(r[0]) > 60_000 and r[2] for r in got)
    assert spelling_variants.spelling_variants(documents(spark, [])).count() == 0
    assert spelling_variants.spelling_variants(documents(spark, [(1, None)])).count() == 0


def test_ties_take_the_smallest_word_and_chains_are_followed(spark):
    text = " ".join(["bbbbb"] * 3 + ["bbbbc"] * 9 + ["bbbba"] * 9 + ["bbbaa"] * 20 + ["bbaaa"] * 41 + ["zzzzz"] * 5)
    got = {r[0]: r for r in variant_rows(spelling_variants.spelling_variants(documents(spark, [(10_007, text)])))}
    want = {r[0]: r for r in brute_variants([(10_007, text)])}
    assert got == want and got["bbbbb"][3:] == ("bbbba", 9, "bbaaa") and got["zzzzz"][2:] == (0, None, None, "zzzzz")


def test_runs_have_the_library_checksum():
    draw = random.Random(3)
    texts = ["".join(draw.choice("abÄé×1 中ÿ\n") for _ in range(draw.randint(0, 400))) for _ in range(50)] + ["q" * 5000]
    ids = [str(draw.randrange(10**9)) for _ in texts]
    data, start, end, crc = spelling_variants.runs(ids, [t.encode() for t in texts])
    want = [(w.group().encode(), zlib.crc32(f"{i}:{lower(w.group())}".encode())) for i, t in zip(ids, texts, strict=True)
            for w in re.finditer("[A-Za-zÀ-ÿ]{5,}", t)]
    assert [(data[a:b].tobytes().decode(), int(c)) for a, b, c in zip(start, end, crc, strict=True)] \
        == [(lower(w.decode()), c) for w, c in want]


# -- chosen path -----------------------------------------------------------------------

def near_rows(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def copies(seed, groups, edits, words=60):
    """Groups of texts at few edits from one another, some of them exact copies."""
    draw = random.Random(seed)
    rows = []
    for _, size in enumerate(groups):
        base = [f"w{draw.randrange(3000)}" for _ in range(words)]
        for _ in range(size):
            text = list(base)
            for _ in range(draw.randint(0, edits)):
                text[draw.randrange(len(text))] = f"e{draw.randrange(10**6)}"
            rows.append((len(rows) * 3 + 1, " ".join(text)))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("groups, edits", [([1] * 80 + [2] * 20 + [5] * 5, 2), ([90, 40, 1, 1, 3], 1), ([120], 3)])
def test_near_duplicates_equal_brute_force(spark, groups, edits):
    rows = copies(sum(groups), groups, edits)
    want = sorted(((i, n, c, i == c) for i, n, c in brute_components(rows, RULE)), key=str)
    assert near_rows(chosen_path.near_duplicates(documents(spark, rows), RULE)) == want


def test_near_duplicate_edge_cases(spark):
    long = " ".join(f"v{k}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE  two"), (5, "one two"), (None, "one two"), (6, "one two three"),
            (7, long), (8, long + " more"), (None, "alone here in the table"), (9, None)]
    got = near_rows(chosen_path.near_duplicates(documents(spark, rows), RULE))
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (9, 0, 9, True), (4, 1, 4, True), (5, 1, 4, False),
                          (5, 1, 4, False), (None, 1, 4, False), (6, 1, 6, True), (7, 59_996, 7, True), (8, 59_997, 7, False),
                          (None, 1, None, True)], key=str)
    assert chosen_path.near_duplicates(documents(spark, []), RULE).count() == 0


def test_two_classes_at_the_threshold_meet_in_some_tree():
    """The recall that the module states, at exactly the threshold and depth 4."""
    draw = np.random.default_rng(5)
    met, pairs = 0, 300
    for _ in range(pairs):
        shared, own = draw.integers(0, 2**63, 340, dtype=np.uint64), draw.integers(0, 2**63, 60, dtype=np.uint64)
        a, b = np.append(shared, own[:30]), np.append(shared, own[30:])
        values = chosen_path.minwise([np.sort(a), np.sort(b)])
        nodes = []
        for v in values:
            row, node = np.zeros(chosen_path.TREES, np.int64), chosen_path._ROOTS
            for _ in range(4):
                at, node = chosen_path.branch(node, v[None].repeat(len(node), 0), 85)
                row = row[at]
            nodes.append(set(node.tolist()))
        met += bool(nodes[0] & nodes[1])
    assert met >= 0.99 * pairs


def test_minwise_values_do_not_depend_on_the_cuts(monkeypatch):
    sets = [np.unique(np.random.default_rng(k).integers(0, 2**63, 1 + 97 * k, dtype=np.uint64)) for k in range(9)]
    whole = chosen_path.minwise(sets)
    monkeypatch.setattr(chosen_path, "HASHED", 64)
    assert (chosen_path.minwise(sets) == whole).all() and (chosen_path.minwise(sets[3:4])[0] == whole[3]).all()


# -- lexical search --------------------------------------------------------------------------

def brute_search(docs, items, ranks=20):
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower(t or ""))
    texts = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(w for _, c in texts for w in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for i, c in texts:
            s = 0
            if c:
                m = 100 - 25 + (25 * sum(c.values()) * n_docs) // total
                for w in terms(text):
                    if c[w]:
                        s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, r[3], -r[0]) for k, r in enumerate(sorted(scored)[:ranks])]
    return sorted(out, key=str)


def search_rows(spark, docs, items):
    names = "item_id long, text string, score long, doc_id string, item string"
    table = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in items], names)
    got = lexical_search.lexical_search(documents(spark, docs), table)
    return sorted((tuple(r) for r in got.collect()), key=str)


def search_tables(seed, docs=300, items=12):
    draw = random.Random(seed)
    words = [f"t{int(draw.paretovariate(0.6)) % 200}" for _ in range(4000)]
    pick = lambda n: " ".join(draw.choice(words) for _ in range(n))
    rows = [(k, pick(draw.choice([1, 5, 30, 200]))) for k in range(docs)]
    rows += [(1000 + k, rows[k][1]) for k in range(0, docs, 3)]
    return rows, [(k, pick(draw.randint(1, 25))) for k in range(items)]


@pytest.mark.parametrize("seed, chunk", [(1, 4096), (2, 16), (3, 1)])
def test_search_equals_brute_force(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(lexical_search, "CHUNK", chunk)
    docs, items = search_tables(seed)
    assert search_rows(spark, docs, items) == brute_search(docs, items)


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_CHARS", 100)
    docs, items = search_tables(4)
    assert search_rows(spark, docs, items) == brute_search(docs, items)


def test_search_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, "... --"), (4, "Alpha beta"), (5, "alpha BETA"), (5, "alpha beta"), (None, "alpha beta"),
            (6, "alpha " * 50_000), (7, "中文 alpha"), *[(100 + k, "alpha gamma") for k in range(40)]]
    items = [(1, "alpha"), (2, None), (3, ""), (4, "beta beta 中文"), (4, "beta beta 中文"), (5, "unknown"), (6, "gamma alpha")]
    got = search_rows(spark, docs, items)
    assert got == brute_search(docs, [i for i in items if i[1]])
    assert [r[2] for r in sorted(r for r in got if r[0] == 6)] == [100 + k for k in range(20)]
    assert search_rows(spark, docs, []) == [] and search_rows(spark, [], items) == [] and search_rows(spark, [(1, None)], items) == []


def test_bounds_hold_and_leaves_are_exact():
    draw = np.random.default_rng(1)
    rows = []
    for k in range(200):
        terms = np.unique(draw.integers(0, 40, draw.integers(1, 15)))
        rows.append((terms, draw.integers(1, 9, len(terms)), int(draw.integers(75, 300)), (False, k)))
    asked, weights = np.arange(0, 40, 3), draw.integers(0, 5000, 14)
    exact = {r[3]: sum(int(w) * int(lexical_search.part(int(r[1][list(r[0]).index(t)]), r[2]))
                       for t, w in zip(asked, weights, strict=True) if t in r[0]) for r in rows}

    def below(node):
        if isinstance(node, list):
            return node
        return list(itertools.chain.from_iterable(below(n) for n in node.nodes))

    def check(node):
        for bound, child in zip(lexical_search.bounds(node, asked, weights), node.nodes, strict=True):
            scores = [exact[i] for i in below(child)]
            assert bound >= max(scores)
            if isinstance(child, list):
                assert all(s == bound for s in scores)
            else:
                check(child)

    root = lexical_search.tree(rows)
    assert sorted(below(root)) == sorted(exact)
    check(root)
