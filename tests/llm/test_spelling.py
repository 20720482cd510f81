"""Spelling variants against brute force."""

import collections
import re
import zlib

import numpy as np

from depweave.llm import spelling
from tests.llm.test_documents import SCHEMA, empty


def brute(rows, factor=5):
    counts = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 6
    n = {w: c for w, c in counts.items() if c >= 5}
    near = {w: [v for v in n if distance_is_one(w, v)] for w in n}
    form = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: f for w, f in form.items() if n[f] >= factor * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n)


def distance_is_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        before = row
    return before[-1] == 1



def order(rows):
    return sorted(rows, key=str)


def test_against_brute_force(spark):
    rnd = np.random.default_rng(3)
    base = ["wonder", "elegant", "straßeÀ", "aaaaaaa", "abcabcab", "ñandúes×", "therein", "ÉTUDES"]
    texts = []
    for _ in range(60):
        words = []
        for _ in range(120):
            w = list(base[rnd.integers(len(base)) if rnd.random() < 0.9 else 0])
            if rnd.random() < 0.3:
                k, c = int(rnd.integers(len(w))), "abeÿ"[rnd.integers(4)]
                kind = rnd.integers(3)
                w[k : k + (kind != 0)] = [] if kind == 1 else [c]
            words.append("".join(w))
        texts.append(" ".join(words))
    texts += [None, "", "12 ..", "x" * 400 + " y", ("x" * 400 + " " + "x" * 399 + " ") * 6, "chainsaw " * 140 + "chainsaws " * 26 + "chainsawst " * 5]
    rows = [(i, t, None, None, None, 1, 2, "3", "4", "5") for i, t in enumerate(texts)]
    rows += [rows[0], rows[1], (None, texts[2], None, None, None, 1, 2, "3", "4", "5")]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute([(r[0], r[1]) for r in rows])
    got = result_of(spelling.spelling_groups(df))
    assert order(got) == order(want)
    assert sum(f is not None for _, f, *_ in got) > 5 and any(r not in (w, f) for w, f, r, *_ in got)
    assert spelling.spelling_groups(empty(spark)).count() == 0


def result_of(df):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]


def test_trie_finds_each_pair_once(spark):
    """Deep nodes, leaves and blocks of all sizes give the same pairs as comparing all words."""
    rnd = np.random.default_rng(4)
    words = sorted({"".join(rnd.choice(list("abékx"), int(rnd.integers(1, 7)))) for _ in range(500)})
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n bigint")
    want = sorted((a, b, j) for a in words for j, b in enumerate(words) if distance_is_one(a, b))
    assert sorted((r.word, r.near, r.near_n) for r in spelling.near_words(df).collect()) == want
    counts = spelling.letter_counts(words)
    at = np.lexsort(counts.T[::-1])
    found = {leaf: sorted(p for p in spelling.search(counts[at], np.zeros(len(words), int), 0, len(words), leaf) if spelling.one_edit(words[at[p[0]]], words[at[p[1]]])) for leaf in (1, 7, 1000)}
    assert found[1] == found[7] == found[1000] and 2 * len(found[1]) == len(want)
