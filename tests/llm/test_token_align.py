"""Token alignment against whole texts aligned by bytes alone."""

import collections
import hashlib
import random

import public_tokenizers as P
import sentencepiece
from tokenizers import Tokenizer

from depweave.llm import token_align
from tests.llm.test_documents import awkward, empty, texts_of

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def printable():
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in own}
    for b in range(256):
        if b not in own:
            table[chr(256 + len(table) - len(own))] = b
    return table


def brute(rows):
    """Everything from the byte ends of whole texts' tokens; all pairs of tokens are compared."""
    one, two, table = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), printable()
    one.encode_special_tokens = True
    docs, counts = [], collections.Counter()
    for doc, text in rows:
        whole = (" " + (text or "")).encode()
        a = one.encode(" " + (text or ""), add_special_tokens=False).ids
        b = two.encode(text or "")
        a_raw = [bytes(table[c] for c in one.id_to_token(i)) for i in a]
        b_raw = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_raw) != whole or b"".join(b_raw) != whole:
            docs.append((doc, None))
            continue
        ends = []
        for side in (a_raw, b_raw):
            at, e = 0, []
            for t in side:
                e.append((at, at + len(t)))
                at += len(t)
            ends.append(e)
        common = sorted({e for _, e in ends[0]} & {e for _, e in ends[1]})
        groups, at = [], [0, 0]
        for c in common:
            part = []
            for k, (ids, spans) in enumerate(((a, ends[0]), (b, ends[1]))):
                first = at[k]
                while at[k] < len(ids) and spans[at[k]][1] <= c:
                    at[k] += 1
                part.append(",".join(map(str, ids[first : at[k]])))
            groups.append("|".join(part))
        links = []
        first = 0
        for x, (s, e) in zip(a, ends[0]):
            while first < len(b) and ends[1][first][1] <= s:
                first += 1
            for k in range(first, len(b)):
                if ends[1][k][0] >= e:
                    break
                links.append((x, b[k]))
        counts.update(links)
        docs.append((doc, (len(a), len(b), groups, links)))
    best = collections.defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for doc, d in docs:
        if d is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = d
            out.append((doc, n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df, **kw):
    return sorted(map(tuple, token_align.align_documents(df, A, B, **kw).collect()), key=str)


def test_awkward_texts(spark):
    df = awkward(spark)
    rnd = random.Random(2)
    words = ["the", "Straße", "é", "漢字", "İx", "<|endoftext|>", "<s>", "<0x41>", "\x00", "a\x00b", "\x1c", "𝔘", "|", "w" * 300, "﻿", "'s", "it's", " ", "🙂🙂", "क्षि", "3.14", "ﬁ", " "]
    gaps = [" "] * 6 + ["\n", "  ", "\t", "\n\n", " \n ", "", " ", "   ", "\r\n"]
    texts = ["".join(rnd.choice(words) + rnd.choice(gaps) for _ in range(rnd.randrange(1, 15))) for _ in range(150)] + ["x▁y", "▁", " ", "  ", " lead", "tail ", "tail  ", "\n", "a", "漢" * 2000]
    rows = [(100 + i, t, "en", None, None, 1, 2, "3", "4", "5") for i, t in enumerate(texts)]
    df = df.unionByName(spark.createDataFrame(rows, df.schema))
    want = brute(texts_of(df))
    assert got(df) == want == got(df, block=300)
    assert sum(r[7] == "" for r in want) >= 4
    assert token_align.align_documents(empty(spark), A, B).count() == 0


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert got(docs.repartition(3)) == brute(texts_of(docs))


def test_spans_leave_shared_characters_whole():
    aligner = token_align.Aligner(A, B)
    one = aligner.a.encode(" 漢x", add_special_tokens=False)
    cuts = token_align.coarse_cuts(token_align.char_ends(" 漢x", [o[0] for o in one.offsets]), token_align.char_ends(" 漢x", [o[1] for o in one.offsets]))
    assert set(cuts) == {4, 5}  # three tokens share the second character
    n_a, n_b, n_groups, groups, pairs = aligner.aligned(" 漢x")
    assert (n_a, n_b) == (len(one.ids), len(aligner.b.encode("漢x"))) and n_groups == groups.count("|")
    assert aligner.aligned(" x▁") is None
