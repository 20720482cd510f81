"""Alignment of two tokenizers' tokens over the same bytes.

Spans that the libraries report are coarse cuts: character offsets of the tokenizers
library, byte spans of a sentencepiece proto.  A span's end cuts only where the next
span begins there, so inside a character that several tokens share, and among
byte-fallback tokens, nothing is cut by spans.  Each stretch between common cuts is then
refined: the tokens' decoded bytes say where each one ends, and are compared with the
text's bytes.  Byte offsets where tokens of both sides end bound the groups.

A text is cut into chunks at single spaces between other characters.  There both
tokenizers always cut (checked on loading: no piece holds a space mark after another
character), so a text's groups are those of its chunks, and equal chunks share one
alignment in a bounded memo.  Chunks that a block adds to the memo are encoded many together,
as they would stand in a text.

Counts of linked id pairs are summed over the corpus by shuffle.  Texts stay in blocks of
a partition: a block keeps each text's chunk numbers and each chunk's pairs, asks for the
counts of its distinct pairs only, and sums them up per text.  What a task holds is one
block and its pairs, whatever the corpus.

Edge cases: null and empty texts, and texts that one of the tokenizers does not give back
byte for byte, have no tokens; they count for no pair.  Repeated rows count as often as
they stand; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depweave.llm.bpe import byte_alphabet, chunks
from depweave.session import written

#: Chunks kept by a worker's memo, and characters of texts in a block (a longer text is a block by itself).
MEMO, BLOCK = 450_000, 1_500_000
#: New chunks that are encoded as one text.
TOGETHER = 256
#: The mark that stands for a space in pieces.
SPACE = "▁"

#: Of a chunk: tokens of either side, groups, their text and the linked id pairs, 64 bits each (None: bytes differ).
Aligned = tuple[int, int, int, str, bytes] | None
_workers: dict[tuple[str, str], "Aligner"] = {}


def char_ends(text: str, ends: list[int]) -> list[int]:
    """Byte offsets of character offsets."""
    if text.isascii():
        return ends
    at = np.cumsum([0, *[len(c.encode()) for c in text]])
    return at[ends].tolist()


def coarse_cuts(begins: list[int], ends: list[int]) -> dict[int, int]:
    """End -> number of tokens before it, for ends where the next span begins (a character that tokens share is not cut)."""
    found = {e: k + 1 for k, (e, b) in enumerate(zip(ends, begins[1:])) if b == e > begins[k]}
    return found | ({ends[-1]: len(ends)} if ends else {})


def refined(a: list[bytes], b: list[bytes], raw: bytes) -> list[tuple[int, int, list[tuple[int, int]]]] | None:
    """(tokens of a, tokens of b, links) of each group of one stretch, links as places in it; None where the bytes differ from ``raw``."""
    if b"".join(a) != raw or b"".join(b) != raw:
        return None
    out, links = [], []
    i = j = first_i = first_j = 0
    end_a, end_b = (len(a[0]) if a else 0), (len(b[0]) if b else 0)
    while i < len(a) and j < len(b):
        links.append((i, j))
        if end_a == end_b:
            out.append((i + 1 - first_i, j + 1 - first_j, links))
            first_i, first_j, links = i + 1, j + 1, []
        ahead_a, ahead_b = end_a <= end_b, end_b <= end_a
        if ahead_a:
            i += 1
            end_a += len(a[i]) if i < len(a) else 0
        if ahead_b:
            j += 1
            end_b += len(b[j]) if j < len(b) else 0
    return out


def refined_ends(spans: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Byte ends of tokens: where spans (begin, end) follow one another, the span's end; in between, what the decoded bytes' ``size`` says."""
    by_bytes = np.cumsum(size)
    clean = np.append((spans[1:, 0] == spans[:-1, 1]) & (spans[:-1, 1] > spans[:-1, 0]), True)
    coarse = np.where(clean, spans[:, 1], 0)
    # a cut that the bytes do not bear out is none
    coarse = np.where(coarse == by_bytes, coarse, 0)
    before = np.append(0, np.maximum.accumulate(coarse)[:-1])
    start = np.append(0, by_bytes)[np.searchsorted(by_bytes, before, "right")] if len(size) else before
    return np.where(coarse > 0, coarse, before + by_bytes - start)


class Aligner:
    """Both tokenizers, their byte tables and ``known``: chunk -> its alignment."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        self.a_bytes = [bytes(map(alphabet.get, t, [63] * len(t))) for t in (self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size()))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(SPACE in p.lstrip(SPACE) for p in pieces) or not self.b.encode("a") or self.b.id_to_piece(self.b.encode("a")[0])[0] != SPACE:
            raise ValueError("pieces must hold their space marks in front, and a text must begin with one")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.many = max(len(self.a_bytes), len(self.b_bytes))
        #: Ids as digits with what follows them: another id, the other side, or the next group.
        self.digits = [f"{i}{end}" for end in (",", "|", ";") for i in range(self.many)]
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.known: dict[str, Aligned] = {}

    @classmethod
    def of(cls, a_path: str, b_path: str) -> "Aligner":
        """This worker's aligner."""
        if (a_path, b_path) not in _workers:
            _workers[a_path, b_path] = cls(a_path, b_path)
        return _workers[a_path, b_path]

    def trim(self) -> None:
        """Forget the chunks seen least recently, down to half of a full memo."""
        if len(self.known) > MEMO:
            for chunk in list(islice(self.known, len(self.known) - MEMO // 2)):
                del self.known[chunk]

    def entries(self, wanted: list[str]) -> list[Aligned]:
        """The alignments of distinct chunks, which count as seen now."""
        self.learn([c for c in wanted if c not in self.known])
        found = list(map(self.known.pop, wanted))
        self.known.update(zip(wanted, found))
        return found

    def aligned(self, chunk: str) -> Aligned:
        """The alignment of a chunk, which begins with a space; the second tokenizer adds that space itself."""
        one, two, raw = self.a.encode(chunk, add_special_tokens=False), self.b.encode(chunk[1:], return_type="proto").pieces, chunk.encode()
        a_ids, b_ids = one.ids, [p.id for p in two]
        a_cuts = coarse_cuts(char_ends(chunk, [o[0] for o in one.offsets]), char_ends(chunk, [o[1] for o in one.offsets]))
        b_cuts = coarse_cuts([p.begin + 1 for p in two], [p.end + 1 for p in two])
        groups, pairs = [], []
        i = j = start = 0
        for end in [e for e in a_cuts if e in b_cuts]:
            next_i, next_j = a_cuts[end], b_cuts[end]
            a, b = a_ids[i:next_i], b_ids[j:next_j]
            found = refined([self.a_bytes[x] for x in a], [self.b_bytes[x] for x in b], raw[start:end])
            if found is None:
                return None
            at_a = at_b = 0
            for n_a, n_b, links in found:
                groups.append(",".join(map(str, a[at_a : at_a + n_a])) + "|" + ",".join(map(str, b[at_b : at_b + n_b])))
                pairs += [a[x] << 32 | b[y] for x, y in links]
                at_a, at_b = at_a + n_a, at_b + n_b
            i, j, start = next_i, next_j, end
        if start != len(raw) or i != len(a_ids) or j != len(b_ids):
            return None
        return len(a_ids), len(b_ids), len(groups), ";".join(groups), np.array(pairs, np.int64).tobytes()

    def learn(self, new: list[str]) -> None:
        """Align ``new`` chunks: those that can follow one another in a text many at once, others by themselves."""
        plain = [c for c in new if not c[-1].isspace() and not c[1].isspace()]
        together = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        texts = ["".join(g) for g in together]
        for chunk in new:
            if chunk[-1].isspace() or chunk[1].isspace():
                self.known[chunk] = self.aligned(chunk)
        one, two = self.a.encode_batch(texts, add_special_tokens=False), self.b.encode([t[1:] for t in texts], num_threads=1, return_type="proto")
        for group, text, a, b in zip(together, texts, one, two):
            if not self._learned(group, text, a, b.pieces):
                for chunk in group:
                    self.known[chunk] = self.aligned(chunk)

    def _learned(self, group: list[str], text: str, one, two) -> bool:
        """Whether the chunks of a text could be aligned together; they are known then."""
        raw = text.encode()
        spans = np.array([x for p in two for x in (p.id, p.begin, p.end)], np.int64).reshape(-1, 3)
        a_ids, b_ids = one.ids, spans[:, 0].tolist()
        if b"".join(map(self.a_bytes.__getitem__, a_ids)) != raw or b"".join(map(self.b_bytes.__getitem__, b_ids)) != raw:
            return False
        a, b = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
        a_spans, b_spans = np.fromiter(chain.from_iterable(one.offsets), np.int64, 2 * len(a_ids)).reshape(-1, 2), spans[:, 1:] + 1
        if not text.isascii():
            code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            a_spans = np.append(0, np.cumsum(1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)))[a_spans]
        a_end, b_end = refined_ends(a_spans, self.a_size[a]), refined_ends(b_spans, self.b_size[b])
        sizes = np.array([len(c) if c.isascii() else len(c.encode()) for c in group])
        bounds = np.cumsum(sizes)
        common = np.intersect1d(a_end, b_end, assume_unique=True)
        if not np.isin(bounds, common, assume_unique=True).all():
            return False
        first, last = np.searchsorted(b_end, a_end - self.a_size[a], "right"), np.searchsorted(b_end, a_end)
        n = last - first + 1  # tokens of b that each token of a overlaps
        linked = np.append(0, np.cumsum(n))
        other = np.repeat(first - linked[:-1], n) + np.arange(linked[-1])
        pairs = (np.repeat(a, n) << 32 | b[other]).tobytes()
        # all ids in the order of their groups, those of a before those of b
        a_cut, b_cut = (np.append(0, np.searchsorted(e, common, "right")) for e in (a_end, b_end))
        words = np.empty(len(a) + len(b), np.int64)
        a_place, b_place = np.arange(len(a)) + np.repeat(b_cut[:-1], np.diff(a_cut)), np.arange(len(b)) + np.repeat(a_cut[1:], np.diff(b_cut))
        words[a_place], words[b_place] = a, b
        words[a_place[a_cut[1:] - 1]] += self.many
        words[b_place[b_cut[1:] - 1]] += 2 * self.many
        written_out = list(map(self.digits.__getitem__, words.tolist()))
        at = [np.append(0, np.searchsorted(e, bounds, "right")) for e in (a_end, b_end, common)]
        ends, links = (at[0] + at[1]).tolist(), (8 * linked[at[0]]).tolist()
        counts = zip(*[np.diff(x).tolist() for x in at])
        for k, (chunk, n) in enumerate(zip(group, counts)):
            self.known[chunk] = *n, "".join(written_out[ends[k] : ends[k + 1]])[:-1], pairs[links[k] : links[k + 1]]
        return True


def chunks_of(text: str) -> list[str]:
    """Parts of a space and the text, each beginning with a space."""
    parts = chunks(" " + text)
    if len(parts) > 1 and parts[-1] == " ":  # a space at the end is no text by itself
        parts[-2:] = [parts[-2] + " "]
    return parts


class Block:
    """Texts of a block: their numbers and digests, chunk numbers, and the chunks' pairs."""

    def __init__(self, aligner: Aligner, name: int):
        self.name, self.chars, self.aligner = name, 0, aligner
        self.texts: list[tuple[int | None, list[str]]] = []

    def add(self, doc: int | None, text: str | None) -> None:
        self.chars += len(text or "")
        self.texts.append((doc, chunks_of(text) if text else []))

    def batch(self) -> pa.RecordBatch:
        """One row per text, then one row of the block's pairs: the distinct ones, how often each is linked, and which ones each chunk has."""
        code: dict[str, int] = {}
        coded = [(doc, np.array([code.setdefault(c, len(code)) for c in parts], np.int32)) for doc, parts in self.texts]
        entries = self.aligner.entries(list(code))
        whole = np.array([e is not None for e in entries], bool)
        none = (0, 0, 0, "", b"")
        entries = [e or none for e in entries]
        texts = [e[3] for e in entries]
        size = np.array([(*e[:3], len(e[4]) // 8) for e in entries], np.int64).reshape(len(entries), 4)
        times = np.zeros(len(entries), np.int64)
        rows: list[tuple] = []
        for doc, codes in coded:
            if not len(codes) or not whole[codes].all():
                rows.append((doc, 0, 0, 0, 0, "", None))
                continue
            times += np.bincount(codes, minlength=len(entries))
            digest = hashlib.sha256(";".join(map(texts.__getitem__, codes.tolist())).encode()).hexdigest()
            rows.append((doc, *size[codes].sum(0).tolist(), digest, codes.astype("<i4").tobytes()))
        sizes = size[:, 3]
        pairs, place = np.unique(np.frombuffer(b"".join([e[4] for e in entries]), np.int64), return_inverse=True)
        linked = np.bincount(place, weights=np.repeat(times, sizes), minlength=len(pairs)).astype(np.int64)
        columns: list[list] = [[self.name] * (len(rows) + 1)] + [[r[k] for r in rows] + [None] for k in range(6)]
        columns += [[r[6] for r in rows] + [place.astype("<i4").tobytes()]]
        columns += [[None] * len(rows) + [x] for x in (sizes.astype("<i4").tobytes(), pairs, linked)]
        types = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=_NAMES)


_NAMES = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "sizes", "pairs", "linked"]
_SCHEMA = "block bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, codes binary, sizes binary, pairs array<bigint>, linked array<bigint>"
RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _align(a_path: str, b_path: str, most: int) -> Callable:
    """mapInArrow over (doc_id, text): the rows of ``Block.batch``, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(a_path, b_path)
        block = Block(aligner, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                block.add(doc, text.as_py())
                if block.chars >= most:
                    yield block.batch()
                    aligner.trim()
                    block = Block(aligner, block.name + 1)
        if block.texts:
            yield block.batch()

    return run


def _score(texts: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """The texts of one block with the sums of their links' counts."""
    own = texts[texts["sizes"].notna()].iloc[0]
    texts = texts[texts["sizes"].isna()]
    count, best = np.zeros(len(own["pairs"]), np.int64), np.zeros(len(own["pairs"]), np.int64)
    count[pairs["k"].to_numpy()], best[pairs["k"].to_numpy()] = pairs["n"].to_numpy(), pairs["best"].to_numpy()
    place, sizes = np.frombuffer(own["codes"], "<i4"), np.frombuffer(own["sizes"], "<i4")
    ends = np.cumsum(sizes)
    per_chunk = [np.append(0, np.cumsum(x[place]))[ends] - np.append(0, np.cumsum(x[place]))[ends - sizes] for x in (best, count)]
    codes = [np.frombuffer(c, "<i4") for c in texts["codes"]]
    out = texts.assign(n_best=[int(per_chunk[0][c].sum()) for c in codes], count_sum=[int(per_chunk[1][c].sum()) for c in codes])
    return out[[c.split()[0] for c in RESULT.split(", ")]]


def align_documents(docs: DataFrame, a_path: str, b_path: str, *, block: int = BLOCK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every whole text."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_align(a_path, b_path, block), _SCHEMA)
    placed = written(rows)
    blocks = placed.filter("sizes is not null").select("block", F.posexplode(F.arrays_zip("pairs", "linked")).alias("k", "x")).select("block", "k", F.col("x.pairs").alias("pair"), F.col("x.linked").alias("linked"))
    counts = blocks.groupBy("pair").agg(F.sum("linked").alias("n"))
    highest = F.max("n").over(Window.partitionBy(F.col("pair").bitwiseAND((1 << 32) - 1)))
    scored = counts.withColumn("best", (F.col("n") == highest).cast("bigint"))
    needed = blocks.select("block", "k", "pair").join(scored, "pair").select(F.col("block").alias("of"), "k", "n", "best")
    made = placed.filter("codes is not null").groupBy("block").cogroup(needed.groupBy("of")).applyInPandas(_score, RESULT)
    none = placed.filter("codes is null").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.lit(0).cast("bigint").alias("n_best"), F.lit(0).cast("bigint").alias("count_sum"), "groups_sha256")
    return made.unionByName(none)
