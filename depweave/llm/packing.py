"""Sum-of-squares packing of tokenized documents into sequences.

Tokens are found word by word (white space always cuts in this vocabulary, so equal
words share one call of the tokenizers library).  Texts with more than ``most`` tokens
are cut into full pieces and a rest.  Pieces are then dealt by a hash into shards of
about ``SHARD`` rows, and each shard is packed by the sum-of-squares rule: with N(g)
open sequences of gap g, a piece goes where the sum of N(g)^2 becomes smallest.  The
state is one count per gap, so a shard's memory is its own rows.

Edge cases: null text is empty and yields one piece, its end token; repeated rows are
packed separately; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.llm.bpe import MEMO, ChunkMemo, Known, _blocks, byte_alphabet

#: Pieces packed together in one task.
SHARD = 100_000
#: Marks that are a piece of their own after a letter.
_MARKS = ",.!?;:"
#: Python splits words at these too; the vocabulary's pre-tokenizer does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")


class WordMemo(ChunkMemo):
    """``known``: word -> its ids as little-endian unsigned 32-bit integers.

    Words of Latin-1 letters, but for marks after them, are one piece each, which is encoded in
    lower case by the tiktoken library with ranks made from the file: a word's end is a zero byte,
    which joins the last letter before anything else does.
    """

    def prepare(self, spec: dict) -> None:
        import tiktoken

        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", ())]
        splits = [x.get("behavior") for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", ())]
        end = spec["model"]["end_of_word_suffix"]
        if steps != ["NFC", "Replace", "Lowercase"] or splits[:1] != ["Removed"] or not end:
            raise ValueError("not a vocabulary of lower-case words without white space")
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        raw = lambda t: bytes(map(alphabet.__getitem__, t.removesuffix(end))) + (b"\0" if t.endswith(end) else b"")
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["model"]["merges"]]
        ranks = {bytes([b, 0]): b for b in range(1, 256)}
        for k, t in enumerate(merged):
            ranks.setdefault(raw(t), 256 + k)
        ranks |= {bytes([b]): 256 + len(merged) + b for b in range(256)}
        ids = {raw(t): i for t, i in vocab.items()}
        self.id = {r: ids.get(b, 0).to_bytes(4, "little") for b, r in ranks.items()}
        self.fast = tiktoken.Encoding("words", pat_str="[^\\x00]+\\x00", mergeable_ranks=ranks, special_tokens={})
        self.core = Known(self.single)

    def single(self, core: str) -> bytes:
        """Ids of a core; letters of Latin-1 in lower case go the fast way."""
        if core.isalpha() and core == core.lower() and (core.isascii() or max(core) <= "\xff"):
            return b"".join(map(self.id.__getitem__, self.fast.encode_ordinary(core + "\0")))
        return np.array(self.encode(core), "<u4").tobytes()

    def made(self, word: str) -> bytes:
        bare = word.rstrip(_MARKS)
        if not bare.isalpha():
            return self.single(word)
        if bare.isascii() or max(bare) <= "\xff":
            bare = bare.lower()
        return self.core[bare] + self.core[word[len(bare) :]] if len(bare) < len(word) else self.core[bare]

    def trim(self) -> None:
        super().trim()
        if len(self.core) > MEMO:
            self.core.clear()


def words_of(text: str | None) -> list[str]:
    """Parts of a text whose encodings, joined, are the encoding of the text."""
    if not text:
        return []
    return [text] if _SEPARATORS.search(text) else text.split()


def _tokenize(path: str, most: int) -> Callable:
    """mapInArrow over (doc_id, text): one row per piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordMemo.of(path)
        for batch in batches:
            out = []
            docs = iter(batch.column(0).to_pylist())
            for block in _blocks(batch.column(1).to_pylist()):
                memo.trim()
                for words in map(words_of, block):
                    doc = next(docs)
                    ids = b"".join(map(memo.known.__getitem__, words)) + bytes(4)
                    for piece, at in enumerate(range(0, len(ids), 4 * most)):
                        part = ids[at : at + 4 * most]
                        out.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            if out:
                doc, piece, start, length, crc = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def sum_of_squares(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, in the given order.

    Moving a sequence from gap g to g - s changes the sum of squares by
    2 * (N(g - s) - N(g)) + 2, filling it by 1 - 2 * N(s), opening one by 2 * N(most - s) + 1;
    of equal changes the smallest gap is taken.
    """
    count = np.zeros(most + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(most + 1)]
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    opened, far = 0, np.int64(1) << 40
    for k, s in enumerate(lengths.tolist()):
        if s == most:
            sequence[k], opened = opened, opened + 1
            continue
        here = count[s:most]
        change = 2 * (count[: most - s] - here) + 2
        change[0] -= 1
        change[here == 0] = far
        g = int(change.argmin())
        if 2 * count[most - s] + 1 < change[g]:
            at, gap, opened = opened, most, opened + 1
        else:
            gap = g + s
            at = stacks[gap].pop()
            count[gap] -= 1
        sequence[k], offset[k] = at, most - gap
        if gap > s:
            stacks[gap - s].append(at)
            count[gap - s] += 1
    return sequence, offset


def fewest(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The rule in two orders, as given and shuffled (always alike); the one that opens fewer sequences counts."""
    given = sum_of_squares(lengths, most)
    order = np.random.default_rng(len(lengths)).permutation(len(lengths))
    other = sum_of_squares(lengths[order], most)
    if not len(lengths) or given[0].max() <= other[0].max():
        return given
    back = np.argsort(order)
    return other[0][back], other[1][back]


def _pack(most: int) -> Callable:
    """applyInPandas over one shard."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        at, offset = fewest(pdf["length"].to_numpy(), most)
        return pdf.assign(sequence_id=pdf["shard"].to_numpy().astype(np.int64) * (1 << 32) + at, offset=offset)[
            ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        ]

    return run


def pack_documents(docs: DataFrame, path: str, *, most: int = 2048, shard_rows: int = SHARD) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece, all documents."""
    pieces = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        _tokenize(path, most), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    )
    shards = max(1, -(-docs.count() // shard_rows))
    return (
        pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(_pack(most), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    )
