"""Operators over documents against brute force, on small awkward tables and on a sample table."""

import collections
import hashlib
import re
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from depweave.llm import bpe, langid, line_dedup, ngram_join, packing, quality, queries, sharding, suffix_dedup

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, name bigint, slot int, score string, _text string, shard string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"wörd{i % 700}" for i in range(9000))
PASSAGE = "this passage of more than fifty bytes stands in several documents of the table"


def awkward(spark):
    base = "the quick brown fox jumps over the lazy dog while seven wizards mix potent brews in the old castle by the sea "
    texts = [
        None, "", "  \n\t ", "a", "one two", "one two", base * 3, base * 3 + "end", "x " + PASSAGE + " y", "z " + PASSAGE, LONG, LONG + " tail",
        "Ünï cödé 漢字 <|endoftext|> it's 'twaś ..", "###!!!", base + "\n" + base + "\n" + "the lazy quick brown fox jumps over dog", "A b\nA b\nA b\n" * 30,
    ]
    rows = [(i, t, "en" if i % 3 else None, None, None, 1, 2, "3", "4", "5") for i, t in enumerate(texts)]
    rows += [rows[5], rows[6], (None, base * 2, "en", "s", 3, 1, 2, "3", "4", "5")]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_ring_law(spark):
    df = awkward(spark)
    got = sharding.shard_documents(df, 4).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((d is None, d or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in texts_of(df))
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(slots) == 4
    assert sharding.shard_documents(empty(spark)).count() == 0


def test_ring_moves_little_and_bounds_loads(spark):
    keys = spark.range(6000).withColumnRenamed("id", "k")
    one = {r.k: r.shard for r in sharding.bounded_ring(keys, "k", 24, slack=0.1).collect()}
    two = {r.k: r.shard for r in sharding.bounded_ring(keys, "k", 25, slack=0.1).collect()}
    assert max(collections.Counter(one.values()).values()) <= -(-6000 * 1.1 // 24)
    assert sum(one[k] != two[k] for k in one) < 0.15 * 6000


def test_ring_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(i, i % 3, f"s{i}", -i) for i in range(60)], "id bigint, Shard int, slot string, _ring_slot int")
    got = sharding.bounded_ring(df, "id", 4)
    assert got.columns == ["id", "Shard", "slot", "_ring_slot", "_shard", "_slot"]
    rows = got.collect()
    assert sorted((r.id, r.Shard, r[2], r[3]) for r in rows) == sorted(tuple(r) for r in df.collect())
    plain = {r.id: (r.shard, r.slot) for r in sharding.bounded_ring(df.select("id"), "id", 4).collect()}
    assert {r.id: (r["_shard"], r["_slot"]) for r in rows} == plain


def test_more_languages_than_rows_of_the_sample(spark):
    """Every labelled language is learnt, however many there are."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k, j: "".join(letters[(k * 7 + j * (k % 5 + 1) + m * (k + 3)) % 26] for m in range(6))
    rows = [(100 * k + i, " ".join(word(k, (i * 3 + j) % 40) for j in range(40)), f"l{k:02}") for k in range(70) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(df, sample=300)
    assert len(model[0]) == 70
    got = langid.predict(df, model, ("doc_id", "lang")).collect()
    assert len({r.lang_pred for r in got}) > 64 and sum(r.lang == r.lang_pred for r in got) > 0.9 * len(rows)


def test_base_rules(spark):
    df = awkward(spark)
    labels = spark.createDataFrame([(6, 1, 0), (6, 1, 0), (7, 0, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality.apply_quality_rules(df, labels).collect())
    want = []
    for d, t in texts_of(df):
        t = t or ""
        w = WORD.findall(t)
        seen = collections.Counter(zip(w, w[1:], w[2:]))
        cover = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        want.append(((d is None, d or 0), len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), failed, not failed))
    assert got == sorted(want)
    assert quality.apply_quality_rules(empty(spark), labels).count() == 0


def test_binomial_cdf_and_cutoffs(spark):
    from math import comb, isclose, log

    cases = [(0, 10, 0.1), (3, 40, 0.02), (12, 500, 0.05)]
    for k, n, p in cases:
        got = spark.range(1).select(quality.log_binomial_cdf(F.lit(k).cast("bigint"), F.lit(n).cast("bigint"), p)).first()[0]
        assert isclose(got, log(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))), rel_tol=1e-9)
    good = spark.range(4000).select(F.lit("s").alias("stratum"), (F.col("id") % 1000 / 1000).alias("v"))
    cut = quality.certified_cutoffs(good, "stratum", {"v": F.col("v")}, {"v": [0.5, 0.9, 0.97, 0.995]}, max_risk=0.05).collect()
    assert [r.cutoff for r in cut] == [0.97]


def test_ordered_cutoffs(spark):
    """Small strata share the pool's cutoffs; a rule stops at its first cutoff that fails."""
    big = spark.range(1200).select(F.lit("a").alias("stratum"), F.lit(0.1).alias("v"))
    few = spark.range(2000).select(F.concat(F.lit("s"), F.col("id") % 8).alias("stratum"), F.lit(0.6).alias("v"))
    rule = {"v": F.col("v")}, {"v": [0.05, 0.5, 0.7, 0.9]}
    both = big.unionByName(few)
    got = {r.stratum: r.cutoff for r in quality.certified_cutoffs(both, "stratum", *rule, max_risk=0.005, ordered=True).collect()}
    assert got == {"a": 0.5, None: 0.7} | {f"s{i}": 0.7 for i in range(8)}
    assert {r.stratum for r in quality.certified_cutoffs(both, "stratum", *rule, max_risk=0.005).collect()} <= {"a"}


def test_bpe(spark):
    df = awkward(spark)
    path = queries.tokenizer_file("byte_bpe_50k.json")
    tk = bpe.ChunkMemo(path).tokenizer
    want = []
    for d, t in texts_of(df):
        ids = tk.encode(t or "", add_special_tokens=False).ids
        want.append((d is None, d or 0, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tk.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    for leaf, long in ((bpe.LEAF, bpe.LONG), (50, 100)):
        got = bpe.encode_and_decode(df, path, leaf=leaf, long=long).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    assert bpe.encode_and_decode(empty(spark), path).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_memo_equals_library(name):
    """Ids of the memo's chunks against the library's of whole texts, on Latin and other letters, marks, digits and special tokens."""
    import random

    rnd = random.Random(5)
    path = queries.tokenizer_file(name)
    memo, cut = (bpe.ChunkMemo(path), bpe.chunks) if name[0] == "b" else (packing.WordMemo(path), packing.words_of)
    words = ["the", "Straße", "ÑANDÚ", "it's", "don't.", "e\u0301", "ſtill", "ΑΣ", "漢字", "ǅ", "İx", "ª", "x²", "12", "3.5", "a,b", "end.", "!!", "(so", "<|endoftext|>", "<|endoftext|>a", "\u00ad", "naïve,", "\x00", "a\x00b", "\x1c", "𝔘", "|", "w" * 300, "\ufeff", "'s", "_x_"]
    gaps = [" "] * 8 + ["\n", "  ", "\t", "\n\n", " \n ", "", "\u00a0", "\r\n", "\u2028"]
    for _ in range(300):
        text = "".join(rnd.choice(words) + rnd.choice(gaps) for _ in range(rnd.randrange(1, 12)))
        want = memo.encode(text)
        got = [memo.known[c] for c in cut(text)]
        assert (",".join(got) == ",".join(map(str, want))) if name[0] == "b" else (b"".join(got) == np.array(want, "<u4").tobytes()), repr(text)
        if name[0] == "b":
            assert "".join([memo.text[c] for c in cut(text)]) == memo.tokenizer.decode(want, skip_special_tokens=False)


def test_sum_of_squares_rule():
    """The vector form against the rule as it is stated, on small sequences."""
    import random

    rnd = random.Random(6)
    for most in (5, 12, 40):
        lengths = [rnd.randrange(1, most + 1) for _ in range(200)]
        gaps: list[list[int]] = [[] for _ in range(most + 1)]  # gap -> open sequences, the last filled last
        opened, want = 0, []
        for s in lengths:
            counts = [len(x) for x in gaps]
            best = None
            for g in [most, *range(s, most)]:
                if g < most and not gaps[g]:
                    continue
                after = list(counts)
                if g < most:
                    after[g] -= 1
                if g - s > 0:
                    after[g - s] += 1
                value = sum(n * n for n in after[1:])
                # of equal values an open sequence counts, that of the smallest gap
                if best is None or (value, g == most, g) < best[0]:
                    best = (value, g == most, g), g
            g = best[1]
            if g == most:
                at, opened = opened, opened + 1
            else:
                at = gaps[g].pop()
            want.append((at, most - g))
            if g > s:
                gaps[g - s].append(at)
        got = packing.sum_of_squares(np.array(lengths), most)
        assert list(zip(got[0].tolist(), got[1].tolist())) == want


@pytest.mark.parametrize("seed", range(3))
def test_tree_join_of_unsplit_runs(seed):
    import random

    rnd = random.Random(seed)
    memo = bpe.ChunkMemo.of(queries.tokenizer_file("byte_bpe_50k.json"))
    lengths = bpe.byte_lengths(memo)
    for alphabet in ("abcdetion's12é", ["a", " ", "  ", "\n", "'s", "ing", "漢", "<|endoftext|>", "!"]):
        t = "".join(rnd.choice(alphabet) for _ in range(600))
        nodes = [bpe.pieces_of(x, memo, lengths) for x in bpe.halves(t, 40)]
        assert bpe.tree_join(nodes, memo.encode) == memo.encode(t)


def test_packing(spark):
    df = awkward(spark)
    path = queries.tokenizer_file("word_bpe_49k.json")
    tk = packing.WordMemo(path).tokenizer
    want = collections.Counter()
    for d, t in texts_of(df):
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            want[d, piece, at, len(part), zlib.crc32(part.tobytes())] += 1
    got = packing.pack_documents(df, path, most=256).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for v in bins.values():
        v.sort()
        assert [o for o, _ in v] == [sum(n for _, n in v[:k]) for k in range(len(v))] and sum(n for _, n in v) <= 256
    assert packing.pack_documents(empty(spark), path).count() == 0


def test_sum_of_squares_wastes_little():
    rnd = np.random.default_rng(3)
    sizes = np.sort(np.minimum(2048, rnd.lognormal(6, 1, 20000).astype(int) + 1))[::-1]
    at, offset = packing.fewest(sizes, 2048)
    assert at.max() + 1 <= 1.02 * sizes.sum() / 2048


def repeats_model(rows, length=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1 if d is not None else 0):
            first[b[k : k + length]] = min(d, first.get(b[k : k + length], d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1 if d is not None else 0):
            if first[b[k : k + length]] < d:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((d is None, d or 0, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def test_repeated_strings(spark, small):
    for df in (awkward(spark), spark.read.parquet(f"{small}/documents.parquet")):
        got = suffix_dedup.dedup_documents(df).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == repeats_model(texts_of(df))
    assert suffix_dedup.dedup_documents(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_merged_transforms(seed):
    rnd = np.random.default_rng(seed)
    strings = list({bytes(rnd.integers(97, 99, rnd.integers(4, 40)).astype(np.uint8)) for _ in range(30)})
    docs = rnd.integers(0, 9, len(strings))
    first = {}
    for s, d in zip(strings, docs):
        for k in range(len(s) - 7):
            first[s[k : k + 8]] = min(d, first.get(s[k : k + 8], d))
    got = {}
    for n, a, b, f in zip(*suffix_dedup.first_documents(strings, docs, 8)):
        got |= {(n, k): f for k in range(a, b)}
    assert got == {(n, k): first[s[k : k + 8]] for n, s in enumerate(strings) for k in range(len(s) - 7)}


def sets_model(rows, n):
    out = []
    for d, t in rows:
        w = WORD.findall(lower(t))
        out.append((d, {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()))
    return out


def components_model(rows, n, percent):
    sets = sets_model(rows, n)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d is None, d or 0, len(s), least.get(find(i))) for i, (d, s) in enumerate(sets))


def test_jaccard_components(spark, small):
    for df in (awkward(spark), spark.read.parquet(f"{small}/documents.parquet")):
        for n, percent in ((4, 85), (5, 80)):
            got = ngram_join.link_components(df, words=n, percent=percent).collect()
            assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in got) == components_model(texts_of(df), n, percent)
    assert ngram_join.link_components(empty(spark)).count() == 0


def test_links_of_null_and_repeated_ids(spark):
    w = [f"w{i}" for i in range(60)]
    a, b, c = (" ".join(w[k : k + 40]) for k in (0, 3, 6))  # a and c are linked through b only
    other = " ".join(f"v{i}" for i in range(50))
    for texts in ([(1, a), (None, b), (2, c), (None, other)], [(3, other), (3, b), (1, a), (2, c), (4, other + " tail")]):
        df = spark.createDataFrame([(d, t) for d, t in texts], "doc_id bigint, text string").coalesce(1)
        got = ngram_join.link_components(df, words=4, percent=80).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in got if r.doc_id) == [r for r in components_model(texts, 4, 80) if not r[0]]


def test_similar_lines(spark, small):
    for df in (awkward(spark), spark.read.parquet(f"{small}/documents.parquet")):
        rows = sorted(texts_of(df), key=lambda r: (r[0] is None, r[0] or 0))
        lines = []
        for d, t in rows:
            for i, x in enumerate((t or "").split("\n")):
                s = set(WORD.findall(lower(x)))
                if len(s) >= line_dedup.MIN_WORDS:
                    lines.append((d, i, s))
        # rows that repeat an id and text are one row's lines
        gone = {(d, i) for k, (d, i, s) in enumerate(lines) if any((e, j) != (d, i) and 100 * len(s & o) >= line_dedup.PERCENT * len(s | o) for e, j, o in lines[:k])}
        want = sorted((d is None, d or 0, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone)) for d, t in rows if t)
        got = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in line_dedup.dedup_documents(df).filter("text is not null and n_lines > 0").collect() if r.text or r.n_removed)
        assert got == want
    assert line_dedup.dedup_documents(empty(spark)).count() == 0


def test_lines_cut_out(spark):
    texts = ["", "a", "a\n", "\n\n", "a\nb\n\nc\n", "é\r\nb\u2028c\nd.*"]
    rows = [(t, gone) for t in texts for gone in ([], [0], [0, 0], [1], list(range(len(t.split("\n")))), [99])]
    df = spark.createDataFrame(rows, "text string, lines array<bigint>")
    got = df.select("text", "lines", line_dedup._without(df["text"], df["lines"]).alias("left")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.left == "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in r.lines)


def test_similar_short_lines(spark):
    lines = ["All rights reserved.", "a b c d", "the end", "x", "all RIGHTS reserved.", "reserved. rights all", "a b c d e", "d c b", "x", "", " ", "", "a b c", "the End", "e d c a q"]
    rows = [(i, x, "en", "s", 0, 1, 2, "3", "4", "5") for i, x in enumerate(lines)] + [(99, "\n".join(lines), "en", "s", 0, 1, 2, "3", "4", "5")]
    for percent in (80, 50):
        sets, want = [], {}
        for r in rows:
            kept = []
            for x in r[1].split("\n"):
                s = set(WORD.findall(lower(x)))
                if not s or not any(100 * len(s & o) >= percent * len(s | o) for o in sets):
                    kept.append(x)
                if s:
                    sets.append(s)
            want[r[0]] = "\n".join(kept)
        for options in ({}, {"rare": 1, "hot": 1, "near": 1, "sent": 1})[percent == 50 :]:
            got = line_dedup.remove_similar_lines(spark.createDataFrame(rows, SCHEMA), percent=percent, **options).collect()
            assert {r.doc_id: r.text for r in got} == want


def test_similar_lines_of_many_sizes(spark):
    """Near copies in chains and stars, unrelated lines of the same words, short rounds and salted keys."""
    import random

    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + [f"r{i}" for i in range(3000)]
    weights = [40] * 60 + [1] * 3000
    lines = []
    for size in (4, 5, 6, 9, 14, 30, 70, 90, 140, 300):
        base = rnd.choices(vocabulary, weights, k=size)
        for _ in range(14):
            near = list(base)
            for _ in range(rnd.randrange(0, max(2, size // 6))):
                near[rnd.randrange(size)] = rnd.choice(vocabulary)
            lines.append(" ".join(near))
            if rnd.random() < 0.3:
                base = near
        lines += [" ".join(rnd.choices(vocabulary, weights, k=size)) for _ in range(4)]
    rnd.shuffle(lines)
    rows = [(i // 3, "\n".join(lines[i : i + 3])) for i in range(0, len(lines), 3)] + [(None, lines[0]), (None, lines[1]), (None, lines[2] + " more")]
    for percent in (80, 60):
        sets, want = [], collections.Counter()
        for doc, text in rows:
            kept = []
            for x in text.split("\n"):
                s = set(WORD.findall(x))
                if not any(100 * len(s & o) >= percent * len(s | o) for o in sets):
                    kept.append(x)
                sets.append(s)
            want[doc, "\n".join(kept)] += 1
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
        for options in ({}, {"rare": 1, "hot": 4, "near": 3, "sent": 2, "wide": 16}) if percent == 80 else ({"rare": 2, "near": 2, "sent": 1, "wide": 64},):
            got = line_dedup.remove_similar_lines(df, percent=percent, **options).collect()
            assert collections.Counter((r.doc_id, r.text) for r in got) == want, options


def test_languages(spark, small):
    from depweave.llm.queries import op1_string_kernel_languages

    docs = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = op1_string_kernel_languages(spark, small).collect()
    assert len(got) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(docs[r.doc_id].lang == r.lang_pred for r in held) >= 0.95 * len(held)
    odd = {r.doc_id: r for r in langid.identify(awkward(spark)).collect()}
    assert odd[0].lang_pred == odd[1].lang_pred == odd[2].lang_pred == odd[13].lang_pred == "und" and odd[0].score == 0
    assert odd[10].lang_pred == "en" and all(0 <= r.score <= 1 for r in odd.values())
    assert langid.identify(empty(spark)).count() == 0
    unlabelled = awkward(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}


def test_similar_lines_of_many_single_classes(spark):
    """Each of many different lines has one near copy elsewhere; none may be lost among lines that occur several times."""
    import random

    rnd = random.Random(8)
    lines = [" ".join(f"{rnd.randrange(900)}w" for _ in range(12)) for _ in range(2500)]
    lines = [x for x in lines if len(set(x.split())) == 12]
    near = [" ".join([f"changed{i}", *x.split()[1:]]) for i, x in enumerate(lines)]
    rows = [(i, x) for i, x in enumerate(lines)] + [(10_000 + i, x) for i, x in enumerate(near)] + [(20_000 + i, f"often seen line {i % 400}") for i in range(1200)]
    got = {r.doc_id: r.text for r in line_dedup.remove_similar_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[i] == x for i, x in enumerate(lines)) and all(got[10_000 + i] == "" for i in range(len(near)))
    assert sum(got[20_000 + i] != "" for i in range(1200)) == 400


def test_words_of_lines():
    """The hashed words are those of the definition, line by line; equal words, and no others, have equal hashes."""
    texts = ["", "\n\n", "A  b\x0b\nC\n", "a\tB\r\nb a", "12345678 123456789 1234567812345678 \u00c4rger \u00e4rger a\x00 a", "x" * 63 + " " + "x" * 64 + " " + "X" * 65 + " " + "x" * 65 + " " + "y" * 5000]
    hashes, owner, many = line_dedup._words([t.encode() for t in texts])
    lines = [x for t in texts for x in t.split("\n")]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = [(i, w.translate(lower)) for i, x in enumerate(lines) for w in WORD.findall(x)]
    assert many.tolist() == [len(t.split("\n")) for t in texts] and owner.tolist() == [i for i, _ in want]
    assert len(set(hashes.tolist())) == len({w for _, w in want}) == len(set(zip(hashes.tolist(), (w for _, w in want))))


def test_later_rounds_read_no_text(spark):
    """Short rounds that compare the closest candidates first, or all at once, agree; the entries are made from the texts once a run."""
    rows = [(i, "\n".join(" ".join(f"w{(i * j + k) % 40}" for k in range(10)) + f" n{i % 7} m{j}" for j in range(3))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    made = []
    inner = line_dedup._entries
    line_dedup._entries = lambda *a: made.append(1) or inner(*a)
    try:
        short = {"rare": 1, "hot": 4, "near": 2, "sent": 1}
        got = [sorted(tuple(r) for r in line_dedup.remove_similar_lines(df, **options).collect()) for options in ({}, short | {"few": 0}, short)]
    finally:
        line_dedup._entries = inner
    assert got[0] == got[1] == got[2] and any(r[3] for r in got[0]) and len(made) == 3


def test_lines_are_cut_without_a_shuffle_of_texts(spark):
    """A short list of lines goes to the texts, a longer one meets those concerned; the results are equal."""
    rows = [(i, f"line of its own number{i}a number{i}b\n" + "a line that many texts share here") for i in range(20)] + [(None, "a line that many texts share here"), (30, None), (31, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        short = line_dedup.remove_similar_lines(df)
        plan = short._jdf.queryExecution().executedPlan().toString()
        longer = line_dedup.remove_similar_lines(df, listed=0)
        got = [sorted((tuple(r) for r in x.collect()), key=str) for x in (short, longer)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    assert got[0] == got[1] and len(got[0]) == len(rows) and sum(r[3] for r in got[0]) == 20


def test_the_language_model_is_fitted_from_packed_rows_a_few_at_a_time(monkeypatch):
    """All rows unpacked at once take 118 MB of the driver here (and 32 times the collected sample in general)."""
    bits = np.random.default_rng(1).integers(0, 256, (900, langid.DIMS // 8), np.uint8)
    y = [("en", "fr", "de")[i % 3] for i in range(len(bits))]
    tracemalloc.start()
    try:
        names, weights = langid.fit(bits, y)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 80 << 20
    monkeypatch.setattr(langid, "ROWS", len(bits))
    again, whole = langid.fit(bits, y)
    assert names == again == ["de", "en", "fr"] and np.allclose(weights, whole, rtol=1e-3, atol=1e-6)


def test_a_short_list_of_classes_goes_to_the_texts(spark, monkeypatch):
    """Whole sets are read by the list of their texts, and no text by bitmaps, while the list is short; a long one gives the same result, as do long lists of lines."""
    rows = [(i, "\n".join([*(" ".join(f"w{(i * j + k) % 40}" for k in range(10)) + f" n{i % 7} m{j}" for j in range(3)), "", *(f"same words in row {k}" for k in range(70))])) for i in range(40)] + [(None, "same words in row 3"), (50, None), (51, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    marked = []
    inner = line_dedup._whole_sets
    monkeypatch.setattr(line_dedup, "_whole_sets", lambda *a: marked.append(1) or inner(*a))
    got = []
    for listed_names in (line_dedup.NAMES, 0):
        got.append((sorted((tuple(r) for r in line_dedup.remove_similar_lines(df, listed_names=listed_names, rare=1, hot=4, near=2, sent=1, few=0).collect()), key=str), len(marked)))
    assert got[0][1] == 0 < got[1][1] and got[0][0] == got[1][0] and len(got[0][0]) == len(rows)
    lines = {doc: len(t.split("\n")) if t is not None else 0 for doc, t in rows}
    assert all(r[2] == lines[r[0]] for r in got[0][0]) and sum(r[3] for r in got[0][0]) > 39 * 70


def test_counts_of_words_are_sent_without_the_unused(spark):
    """A task sends the counters in use only; few or many, small or large, their levels are those of the sums."""
    size, rng = 1 << 16, np.random.default_rng(3)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([7]), pa.array(["a b c\nc d " + "e " * 5])], names=["doc", "tkey", "text"])
    sent = [x for b in line_dedup._lines(1, size)(iter([batch])) for x in b.to_pylist() if x["piece"] is not None]
    assert sum(len(x["counts"]) + len(x["larger"]) for x in sent) == 3 * 5
    tables = [np.zeros(size, np.uint32) for _ in range(4)]
    for t, used in zip(tables, (10, 3000, size // 3 + 1, size)):
        t[rng.choice(size, used, replace=False)] = rng.integers(1, 700, used)
    rows = pd.DataFrame([{"piece": 0, "counts": a, "larger": b} for a, b in map(line_dedup._piece, tables)])
    want = np.minimum(255, 8 * np.log2(sum(t.astype(np.int64) for t in tables) + 1.0)).astype(np.uint8)
    assert line_dedup._summed(size)(rows)["levels"][0] == want.tobytes()


def test_whole_sets_come_from_the_asked_lines_only(monkeypatch):
    texts = ["first line here\nSecond, line\n\nthe last one", "short", None]
    every = line_dedup.Lines([texts[0].encode()], 1)
    asked = [[{"name": int(every.name[j]), "line": int(every.line[j])} for j in (0, 2)], [{"name": int(every.name[2]), "line": 3}], [{"name": 5, "line": 0}]]
    batch = pa.RecordBatch.from_arrays([pa.array(asked, pa.list_(pa.struct([("name", pa.int64()), ("line", pa.int64())]))), pa.array(texts)], names=["asked", "text"])
    seen, inner = [], line_dedup.Lines
    monkeypatch.setattr(line_dedup, "Lines", lambda raws, n: seen.extend(raws) or inner(raws, n))
    got = {x["name"]: x["tokens"] for b in line_dedup._asked_sets(1)(iter([batch])) for x in b.to_pylist()}
    assert got == {int(every.name[j]): every.token[every.first[j] : every.first[j] + every.size[j]].tobytes() for j in (0, 2)}
    assert seen == [b"first line here\nthe last one", b"", b""]


def test_undecided_pairs_wait_for_the_next_look_at_the_texts(spark, monkeypatch):
    """Texts are read for the closest candidates, and once more for all others together with those of the next round; results are those of many rounds."""
    rows = [(i, "\n".join(" ".join(f"w{(i * j + k) % 40}" for k in range(10)) + f" n{i % 7} m{j}" for j in range(3))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    looks, got, inner = [], [], line_dedup._asked_sets
    monkeypatch.setattr(line_dedup, "_asked_sets", lambda *a: looks.append(1) or inner(*a))
    short = {"rare": 1, "hot": 4, "near": 2, "sent": 1}
    for options in (short | {"few": 150}, short | {"few": 0, "wanted": 0}, short):
        before = len(looks)
        got.append((sorted(tuple(r) for r in line_dedup.remove_similar_lines(df, **options).collect()), len(looks) - before))
    assert got[0][0] == got[1][0] == got[2][0] and any(r[3] for r in got[0][0])
    assert [x[1] for x in got] == [3, 3, 2]


def test_entries_left_equal_by_packed_numbers():
    """Ties of key and size are put in order by name, place and, where sizes outgrow the packed numbers, size."""
    rng = np.random.default_rng(5)
    for sizes in ([3, 4], [0xFFFE, 0xFFFF, 0x10000, 0x20000]):
        x = np.zeros(4000, line_dedup._ENTRY)
        x["key"], x["size"], x["at"] = rng.integers(0, 5, 4000), rng.choice(sizes, 4000), rng.integers(0, 9, 4000)
        x["name"] = rng.choice(np.append(rng.integers(-(1 << 63), (1 << 63) - 1, 300), np.arange(-20, 20)), 4000)
        got, key, size = line_dedup._sorted_entries(x)
        want = sorted({(int(k), int(s), int(n)): 0 for k, s, n in zip(x["key"], x["size"], x["name"])})
        first = {}
        for k, s, n, a in zip(x["key"], x["size"], x["name"], x["at"]):
            first[int(k), int(s), int(n)] = min(int(a), first.get((int(k), int(s), int(n)), 1 << 40))
        found = list(zip(key.tolist(), size.tolist(), got["name"].tolist(), got["at"].tolist()))
        assert [f[:3] for f in found] == want and all(first[f[:3]] == f[3] for f in found)
