"""BPE encoding and decoding of whole texts, long ones by tree concatenation.

Short texts are encoded chunk by chunk: a chunk begins at a space that follows a
non-space, where the vocabulary's pre-tokenizer always cuts, so chunks are independent
and equal ones share one call of the tokenizers library (a bounded memo per worker).
A text's ids are those of its chunks, and its decoded text is put together from the
decoded ids of its chunks.  Chunks of Latin characters are encoded by the tiktoken
library, which is faster, with ranks made from the same file; tests hold both libraries'
ids to be equal.  These rules hold for byte-level vocabularies with the usual splitting
pattern whose ids rise with the order of merges; another vocabulary is refused.

Long texts are halved until the parts are at most ``LEAF`` characters.  The parts are
rows of their own, so one long text is encoded by many tasks.  Parts are then joined
pairwise, level by level: a window around the join is encoded anew and grows until its
first and last chunks agree with what both sides had; from there on both sides stand,
since pre-tokens restart at chunk bounds and, inside one unsplit run, a token sequence
all of whose neighbours are compatible is the encoding itself.

Edge cases: null text counts as empty (no tokens); repeated rows stay apart, as long
texts are grouped by a row number of the scan; empty tables give no rows; only the key
and text columns are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a part, and the length from which texts are split into parts.
LEAF = 16_384
LONG = 2 * LEAF
#: Chunks kept by a worker's memo.
MEMO = 250_000
#: Tokens after which an unsplit run is cut into pieces for the windows.
RUN = 16

_SPACE_RUN = re.compile(r"\s ")
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_workers: dict[tuple[type, str], "ChunkMemo"] = {}
#: The usual splitting pattern (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Latin characters: all versions of Unicode agree on which of them are letters.
LATIN = "\u024f"


def chunks(text: str) -> list[str]:
    """Parts of ``text`` whose encodings, joined, are the encoding of the text."""
    if not _SPACE_RUN.search(text) and "\0" not in text:
        parts = text.replace(" ", "\0 ").split("\0")
        return parts if parts[0] else parts[1:]
    first, *rest = _SINGLE_SPACE.split(text)
    return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or (161 <= b and b != 173)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Known(dict):
    """A dictionary that makes what it lacks."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class ChunkMemo:
    """``known``: chunk -> its ids as text, joined by commas; ``text``: chunk -> what its ids decode to."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.known = Known(self.made)
        self.text: dict[str, str] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.prepare(json.loads(self.tokenizer.to_str()))

    @classmethod
    def of(cls, path: str) -> "ChunkMemo":
        """This worker's memo."""
        if (cls, path) not in _workers:
            _workers[cls, path] = cls(path)
        return _workers[cls, path]

    def prepare(self, spec: dict) -> None:
        """Tables of the vocabulary; one that the rules of ``chunks`` do not hold for is refused."""
        import tiktoken

        pre, added = spec["pre_tokenizer"] or {}, spec["added_tokens"]
        ids = [spec["model"]["vocab"].get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in spec["model"]["merges"]]
        spaced = any(t["lstrip"] or t["rstrip"] or any(map(str.isspace, t["content"])) for t in added)
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or spaced or None in ids or ids != sorted(ids):
            raise ValueError("not a byte-level vocabulary of the usual kind")
        alphabet, special = byte_alphabet(), {t["id"]: t["content"].encode() for t in added}
        size = self.tokenizer.get_vocab_size()
        self.digits = [str(i) for i in range(size)]
        self.bytes = [special[i] if i in special else bytes(map(alphabet.__getitem__, self.tokenizer.id_to_token(i) or "")) for i in range(size)]
        self.special = [t["content"] for t in added]
        self.fast = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks={b: i for i, b in enumerate(self.bytes) if i not in special}, special_tokens={})

    def ids_of(self, chunk: str) -> list[int]:
        if (chunk.isascii() or max(chunk) <= LATIN) and not any(x in chunk for x in self.special):
            return self.fast.encode_ordinary(chunk)
        return self.encode(chunk)

    def made(self, chunk: str) -> str:
        """What ``known`` holds for a chunk; what its ids decode to goes to ``text``."""
        ids = self.ids_of(chunk)
        text = b"".join(map(self.bytes.__getitem__, ids)).decode(errors="replace")
        self.text[chunk] = chunk if text == chunk else text
        return ",".join(map(self.digits.__getitem__, ids))

    def trim(self) -> None:
        """Empty a full memo (between blocks, so that its size is bounded by ``MEMO`` and a block)."""
        if len(self.known) > MEMO:
            self.known.clear()
            self.text.clear()

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


def _blocks(values: list, most: int = 400_000) -> Iterator[list]:
    """Consecutive values of at most about ``most`` characters together."""
    block, size = [], 0
    for v in values:
        if block and size + len(v or "") > most:
            yield block
            block, size = [], 0
        block.append(v)
        size += len(v or "")
    if block:
        yield block


def _digests(ids: str, decoded: str) -> tuple[int, str, str]:
    return ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def _encode_whole(path: str) -> Callable:
    """mapInArrow over (doc_id, text): the digests of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = ChunkMemo.of(path)
        for batch in batches:
            out = []
            for block in _blocks(batch.column(1).to_pylist()):
                memo.trim()
                for t in block:
                    parts = chunks(t) if t else []
                    out.append(_digests(",".join(map(memo.known.__getitem__, parts)), "".join(map(memo.text.__getitem__, parts))))
            n, a, b = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def halves(text: str, leaf: int = LEAF) -> list[str]:
    """The parts of a text: halved until none is longer than ``leaf``."""
    if len(text) <= leaf:
        return [text]
    mid = len(text) // 2
    return halves(text[:mid], leaf) + halves(text[mid:], leaf)


def _split(leaf: int) -> Callable:
    """mapInArrow over (row, doc_id, text): one row per part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, text in zip(*[c.to_pylist() for c in batch.columns]):
                parts = halves(text, leaf)
                for i in range(0, len(parts), 64):
                    some = parts[i : i + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * len(some), pa.int64()), pa.array([doc] * len(some), pa.int64()), pa.array(range(i, i + len(some)), pa.int32()), pa.array(some, pa.string())],
                        names=["row", "doc_id", "part", "text"],
                    )

    return run


def pieces_of(text: str, memo: ChunkMemo, byte_length: list[int]) -> list[tuple[str, list[int]]]:
    """(text, ids) of the chunks, long runs cut further at token bounds that are character bounds."""
    out = []
    for chunk in chunks(text):
        ids = memo.ids_of(chunk)
        if len(ids) <= 2 * RUN:
            out.append((chunk, ids))
            continue
        raw, at, start, first = chunk.encode(), 0, 0, 0
        for k, i in enumerate(ids):
            at += byte_length[i]
            whole = at == len(raw) or raw[at] & 0xC0 != 0x80
            if k + 1 == len(ids) or (k + 1 - first >= RUN and whole):
                out.append((raw[start:at].decode(), ids[first : k + 1]))
                start, first = at, k + 1
    return out


def byte_lengths(memo: ChunkMemo) -> list[int]:
    """UTF-8 bytes of each token."""
    return list(map(len, memo.bytes))


def _encode_parts(path: str) -> Callable:
    """mapInArrow over (row, doc_id, part, text): adds the pieces' characters and ids, as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = ChunkMemo.of(path)
        lengths = byte_lengths(memo)
        for batch in batches:
            found = [pieces_of(t, memo, lengths) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([[len(t) for t, _ in x] for x in found], pa.list_(pa.int32())), pa.array([[len(i) for _, i in x] for x in found], pa.list_(pa.int32())), pa.array([[j for _, i in x for j in i] for x in found], pa.list_(pa.int32()))],
                names=["row", "doc_id", "part", "text", "chars", "counts", "ids"],
            )

    return run


Node = list[tuple[str, list[int]]]


def join_nodes(a: Node, b: Node, encode: Callable[[str], list[int]]) -> Node:
    """The encoding of both texts together: windows of 2, 4, 8 ... pieces a side until both sides agree."""
    if not a or not b:
        return a or b
    w = 2
    while True:
        wa, wb = min(w, len(a)), min(w, len(b))
        window = "".join(t for t, _ in a[-wa:]) + "".join(t for t, _ in b[:wb])
        ids = encode(window)
        left, right = a[-wa][1], b[wb - 1][1]
        agree = (wa == len(a) or ids[: len(left)] == left) and (wb == len(b) or ids[-len(right) :] == right)
        if agree and (len(ids) >= len(left) + len(right) or (wa == len(a) and wb == len(b))):
            # the outer pieces stay pieces of their own, so that later windows can be small
            head = [a[-wa]] if wa < len(a) else []
            tail = [b[wb - 1]] if wb < len(b) else []
            inner_ids = ids[len(left) if head else 0 : len(ids) - (len(right) if tail else 0)]
            inner = window[len(head[0][0]) if head else 0 : len(window) - (len(tail[0][0]) if tail else 0)]
            middle = [(inner, inner_ids)] if inner else []
            return a[: len(a) - wa] + head + middle + tail + b[wb:]
        w *= 2


def tree_join(nodes: list[Node], encode: Callable[[str], list[int]]) -> list[int]:
    """Ids of the concatenated texts of ``nodes``, joined pairwise level by level."""
    while len(nodes) > 1:
        nodes = [join_nodes(nodes[i], nodes[i + 1], encode) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
    return [i for _, ids in nodes[0] for i in ids] if nodes else []


def _join_parts(path: str) -> Callable:
    """applyInPandas over the parts of one text."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        memo = ChunkMemo.of(path)
        nodes: list[Node] = []
        for r in pdf.sort_values("part").itertuples():
            node, at, first = [], 0, 0
            for n, k in zip(r.chars, r.counts):
                node.append((r.text[at : at + n], [int(i) for i in r.ids[first : first + k]]))
                at, first = at + n, first + k
            nodes.append(node)
        ids = tree_join(nodes, memo.encode)
        n, a, b = _digests(",".join(map(str, ids)), memo.tokenizer.decode(ids, skip_special_tokens=False))
        return pd.DataFrame({"doc_id": pdf["doc_id"][:1], "n_tokens": [n], "ids_sha256": [a], "decoded_sha256": [b]})

    return run


def encode_and_decode(docs: DataFrame, path: str, *, leaf: int = LEAF, long: int = LONG) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, by the vocabulary file at ``path``."""
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    is_long = F.coalesce(F.length("text") > long, F.lit(False))
    whole = rows.filter(~is_long).mapInArrow(_encode_whole(path), schema)
    parts = (
        rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").filter(is_long)
        .mapInArrow(_split(leaf), "row bigint, doc_id bigint, part int, text string")
        .repartition(4 * docs.sparkSession.sparkContext.defaultParallelism, "row", "part")  # a number of its own: few bytes, much work
        .mapInArrow(_encode_parts(path), "row bigint, doc_id bigint, part int, text string, chars array<int>, counts array<int>, ids array<int>")
    )
    return whole.unionByName(parts.groupBy("row").applyInPandas(_join_parts(path), schema))
