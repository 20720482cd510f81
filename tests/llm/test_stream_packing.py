"""Bounded-space packing: round trip of all tokens, padding, and the rule as it is stated."""

import collections
import random
import zlib

import numpy as np

from depweave.llm import bpe, queries, stream_packing
from tests.llm.test_documents import awkward, empty, texts_of


def check(rows, want, most):
    """Every document's ids once and in order, sequences gapless; returns the padding."""
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r.sequence_id].append(r)
    padding = 0
    for v in pieces.values():
        at = 0
        for r in sorted(v, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= most
        padding += 0 if at & (at - 1) == 0 else most - at
    left = collections.Counter()
    for doc, ids in want:
        left[doc, len(ids)] += 1
    for (doc, total), n in left.items():
        mine = sorted((r.start, r.length) for r in rows if r.doc_id == doc and r.doc_tokens == total)
        covered = np.zeros(total, int)
        for s, k in mine:
            covered[s : s + k] += 1
        assert (covered == n).all()
    by_doc = collections.defaultdict(list)
    for doc, ids in want:
        by_doc[doc, len(ids)].append(np.array(ids, "<u4"))
    for r in rows:
        assert r.ids_crc32 in {zlib.crc32(x[r.start : r.start + r.length].tobytes()) for x in by_doc[r.doc_id, r.doc_tokens]}
    return padding


def test_all_tokens_once_without_padding(spark):
    path = queries.tokenizer_file("byte_bpe_50k.json")
    tk = bpe.ChunkMemo(path).tokenizer
    df = awkward(spark)
    want = [(d, [*tk.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in texts_of(df)]
    for most, windows, parts, merged in ((1024, 64, 1, 64), (64, 2, 3, 2), (128, 1, 5, 64)):
        rows = stream_packing.pack_stream(df.repartition(parts), path, most=most, windows=windows, merged=merged).collect()
        assert check(rows, want, most) == 0
    assert stream_packing.pack_stream(empty(spark), path).count() == 0


def test_whole_table(spark, small):
    path = queries.tokenizer_file("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    tk = bpe.ChunkMemo(path).tokenizer
    want = [(d, [*tk.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in texts_of(docs)]
    rows = stream_packing.pack_stream(docs.repartition(4), path).collect()
    assert check(rows, want, 1024) == 0
    cut = {(r.doc_id) for r in rows if r.doc_tokens <= 1024 and r.length < r.doc_tokens}
    assert len(cut) < 0.5 * len(want)


def test_rule():
    """Against the rule as it is stated, step by step."""
    rnd = random.Random(1)
    for most, windows in ((16, 1), (16, 3), (50, 8)):
        got, want, open_ = [], [], []
        packer = stream_packing.Windows(most, windows, lambda p: got.append(sorted((d, s, len(i) // 4) for d, s, i, _ in p)))
        for doc in range(400):
            n = total = rnd.randrange(1, 3 * most) if doc % 7 == 0 else rnd.randrange(1, most)
            packer.add(doc, 0, bytes(4 * n), n)
            start = 0
            while n > most or (n == most):
                want.append([(doc, start, min(n, most))])
                start, n = start + most, n - min(n, most)
            while n:
                fits = [w for w in open_ if most - sum(x[2] for x in w) >= n]
                if not fits and len(open_) < windows:
                    open_.append([])
                    fits = [open_[-1]]
                best = max(fits or open_, key=lambda w: sum(x[2] for x in w))
                k = min(n, most - sum(x[2] for x in best))
                best.append((doc, start, k))
                start, n = start + k, n - k
                if sum(x[2] for x in best) == most:
                    open_.remove(best)
                    want.append(sorted(best))
            assert total == start
            assert len(packer.open) <= windows
        fills = lambda rows: sorted(len(r) for r in rows)
        assert all(sum(x[2] for x in r) == most for r in got)
        assert len(got) == len(want) and abs(sum(fills(got)) - sum(fills(want))) <= 0.05 * sum(fills(want))


def test_powers_of_two():
    pieces = [(1, 0, bytes(4 * 5), 5), (2, 3, bytes(4 * 300), 303), (None, 0, bytes(4), 1)]
    rows = list(stream_packing.powers_of_two(pieces))
    assert [sum(len(p[2]) // 4 for p in r) for r in rows] == [256, 32, 16, 2]
    assert [(p[0], p[1], len(p[2]) // 4) for r in rows for p in r] == [(1, 0, 5), (2, 3, 251), (2, 254, 32), (2, 286, 16), (2, 302, 1), (None, 0, 1)]
