"""Line dedup by an exact set-similarity join of token sets.

A line's set is its distinct words (ASCII letters in lower case); every line with a word
takes part (with ``min_words`` those with as many).  A line goes if an earlier line, in the order
of document id and line number, has a set whose Jaccard similarity with its own reaches
``percent``; "earlier" counts lines that go themselves, so the result does not depend on
an order of removal.

Equal sets are one class, whose later members all go.  Between classes the join runs on
prefixes: tokens are ordered from rare to common by a table of hashed counters over all
lines.  Two sets that reach the threshold share one of each side's first
n - ceil(t n) + 1 tokens, and two of the first n - ceil(t n) + 2.  If the first token
they share is rare (seen in at most ``RARE`` places), they meet in that token's key;
else all tokens they share are common and they meet in the key of the first two.  (Sets
from ``WIDE`` words on, whose pairs would be many, meet in common tokens' own keys; those
near that size have both kinds.)  Sets too short to match any but an equal one (up to 3 words at 80 %) have no key.

Keys are dealt to tasks by ranges of their hashes.  Inside a task a pair of one key must
pass the length bound, the positional bound (from the first tokens they share on, two
sets share no more than the shorter rest) and a bound from 96-bit parities of the tokens
(differing bits never outnumber differing tokens) before it leaves the task.  As one
earlier match is enough, each class sends its closest candidates only, whose whole sets
are compared; a class that had more than it sent, and was not decided by them, is
looked at again with sixteen times as many (more, if few classes are left), until none is left;
for that the first round
stores the entries of the keys that held more, so that later ones read no text.  Of those sent the
closest is compared first; where it does not match, the others wait and are compared with those of the next round,
in one look at the texts.  A key that could hold
more than ``HOT`` lines (its tokens' counters say so) is salted: its classes are spread
over several tasks, and in the later rounds the undecided ones visit all of them.

Edge cases: null and empty texts stay as they are; lines without a word stay; a
null id counts as the last; rows that repeat an id are ordered line by line, told apart
by 32 bits of their text's hash; very long lines are taken whole; an empty table gives no
rows; extra columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweave.llm import shared
from depweave.llm.ngram_join import COUNTERS, _blocks, mix
from depweave.session import cut, discard, release, small_batches, written

MIN_WORDS = 1
#: Stands for a null id, the last of all.
NO_ID = (1 << 63) - 1
PERCENT = 80
#: Places of a token up to which it makes a key by itself.
RARE = 512
#: Words from which common tokens make keys by themselves too.
WIDE = 256
#: Lines that a key may hold before it is salted, neighbours (by size) that the first round looks at, candidates it sends.
HOT = 1 << 16
NEAR = 512
SENT = 8
GATHER = 500_000
#: Pairs a task may hold before it keeps each class's closest only.
PAIRS = 1 << 20
#: Pairs up to which a round compares all candidates at once, as each look at the texts costs more than they do.
FEW = 1 << 17
#: Pairs that the classes of a later round may send, where that is more than sixteen times as many as before.
WANTED = 1 << 22
#: Bytes of the list of lines that go (some 80 a text, 8 a line) up to which it is broadcast.
LISTED = 32 << 20
#: Classes up to which their list is broadcast (some 80 bytes each), so that rows meet it without Python; more are told by bitmaps and then joined.
NAMES = LISTED // 80
#: Numbers of lines up to which each line of a text is looked up in their list.
SHORT = 64
_WORDS = 3
#: (``common``: the level of the key's rarest token)
_ENTRY = np.dtype([("key", "<u4"), ("key_b", "<u2"), ("name", "<i8"), ("at", "<u4"), ("size", "<u4"), ("lost", "u1"), ("common", "u1"), ("bits", "<u4", (_WORDS,))])
#: Marks a size in an entry that all of its key must be compared with.
_OPEN = np.uint32(1 << 31)


#: The bytes of a word that are hashed at once by arrays; longer words one by one.
_LONG = 64
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Counters of a piece of the table of counts.
PIECE = 1 << 16


def _words(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every word, ASCII letters in lower case; number of its line; lines of each text): the lines of all texts in order."""
    joined = b"\n".join(raws).lower()
    buf = np.frombuffer(b"\n" + joined + b"\n" + bytes(8), np.uint8)
    seen = buf[:-8]
    space = (seen == 32) | ((seen - np.uint8(9)) < 5)
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, size = edge[0::2], edge[1::2] - edge[0::2]
    many = np.array([raw.count(b"\n") + 1 for raw in raws], np.int64)
    before = np.concatenate([[0], np.searchsorted(start, np.flatnonzero(seen[1:-1] == 10) + 1), [len(start)]])
    owner = np.repeat(np.arange(len(before) - 1), np.diff(before))
    eight = np.ndarray(len(buf) - 7, "<u8", buf, strides=(1,))
    with np.errstate(over="ignore"):
        hashes = mix((eight[start] & _MASK[np.minimum(size, 8)]) + size.astype(np.uint64) * _ODD)
        at, left = 8, np.flatnonzero((size > 8) & (size <= _LONG))
        while len(left):
            part = eight[start[left] + at] & _MASK[np.minimum(size[left] - at, 8)]
            hashes[left] = mix(hashes[left] * _ODD + part)
            at += 8
            left = left[size[left] > at]
    for i in np.flatnonzero(size > _LONG).tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(seen[start[i] : start[i] + size[i]].tobytes(), digest_size=8).digest(), "little")
    return hashes, owner, many


def _level(count: int) -> int:
    """The commonness byte of a count."""
    return int(8 * np.log2(count + 1))


def _sorted(owner: np.ndarray, first: np.ndarray | None, token: np.ndarray) -> np.ndarray:
    """An order by owner, ``first`` (a byte) and token: one sort of packed keys, unless packing made two tokens equal."""
    bits = max(1, int(owner[-1]).bit_length()) if len(owner) else 1
    packed = owner.astype(np.uint64) << np.uint64(64 - bits)
    if first is not None:
        bits += 8
        packed |= first.astype(np.uint64) << np.uint64(64 - bits)
    packed |= token >> np.uint64(bits)
    order = np.argsort(packed)
    packed, token = packed[order], token[order]
    if ((packed[1:] == packed[:-1]) & (token[1:] != token[:-1])).any():
        return np.lexsort((token, owner) if first is None else (token, first, owner))[: len(order)]
    return order


class Lines:
    """The token sets of the lines of some texts that have enough words, as flat arrays."""

    def __init__(self, raws: list[bytes], min_words: int):
        word, owner, many = _words(raws)
        order = _sorted(owner, None, word)
        word, owner = word[order], owner[order]
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])
        word, owner = word[new], owner[new]
        size = np.bincount(owner, minlength=int(many.sum()))
        keep = size >= max(1, min_words)
        self.token = word[keep[owner]]
        at = np.flatnonzero(keep)
        self.size = size[at]
        self.text = np.repeat(np.arange(len(raws)), many)[at]
        self.line = at - (np.cumsum(many) - many)[self.text]
        self.first = np.cumsum(self.size) - self.size
        self.owner = np.repeat(np.arange(len(at)), self.size)
        # a set's name: a sum over its tokens, so that their order does not matter
        self.name = mix(np.add.reduceat(mix(self.token ^ np.uint64(0x5851F42D4C957F2D)), self.first) + self.size.astype(np.uint64)).view(np.int64) if len(at) else at

    def keys(self, level: np.ndarray, percent: int, rare: int, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(key, line, lost, level): ``lost`` tokens cannot be shared if the key's are the first that are; ``level`` of the key's rarest token."""
        common = level[(self.token & np.uint64(len(level) - 1)).astype(np.int64)]
        want = np.minimum(self.size, self.size - (self.size * percent + 99) // 100 + 2)
        want[100 * self.size < percent * (self.size + 1)] = 0
        order = _sorted(self.owner, common, self.token)
        place = np.arange(len(order)) - np.repeat(self.first, self.size)
        order = order[place < want[self.owner]]
        token, row, common = self.token[order], np.repeat(np.arange(len(want)), want), common[order]
        place = np.arange(len(token)) - np.repeat(np.cumsum(want) - want, want)
        alone = common <= _level(rare)
        # one shared token may be enough in the shortest sets
        one = ((self.size * percent <= 100) | (self.size >= wide))[row]
        # the last place serves pairs only; a token that was seen once is in no other line
        single = (alone | one) & (common > _level(1)) & ((place < want[row] - 1) | (want[row] == self.size[row]))
        found = [(token[single], row[single], place[single], common[single])]
        use = ~alone & (self.size * percent <= 100 * wide)[row]
        token, row, place, common = (x[use] for x in (token, row, place, common))
        longest = int(np.bincount(row).max()) if len(row) else 0
        for step in range(1, longest):
            same = row[step:] == row[:-step]
            a, b = token[:-step][same], token[step:][same]
            with np.errstate(over="ignore"):
                key = mix(np.minimum(a, b) + np.maximum(a, b) * np.uint64(0x9E3779B97F4A7C15))
            found.append((key, row[step:][same], place[step:][same] - 1, common[:-step][same]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def parities(self) -> np.ndarray:
        """``_WORDS`` times 32 bits a set, each the parity of the tokens that fall on it."""
        bit = (self.token >> np.uint64(40)) % np.uint64(32 * _WORDS)
        one = np.uint32(1) << (bit & np.uint64(31)).astype(np.uint32)
        out = np.zeros((len(self.size), _WORDS), np.uint32)
        for w in range(_WORDS):
            out[:, w] = np.bitwise_xor.reduceat(np.where(bit >> np.uint64(5) == w, one, np.uint32(0)), self.first)
        return out


def _lines(min_words: int, counters: int) -> Callable:
    """mapInArrow over (doc, tkey, text): one row per line that takes part (``pos`` is its number and 32 bits of the text's hash), then how many of them hold each token, by piece of the table of counters.

    One pass for both, as reading the words is most of the work.  A piece is a byte a counter (only of those in use, after their places, where that is shorter), and (place, count) of those that a byte can't hold.
    """
    names = ["doc", "pos", "name", "piece", "counts", "larger"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(counters, np.uint32)
        for batch in batches:
            doc, tkey = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for rows, raws in _blocks(batch, 2):
                x = Lines(raws, min_words)
                if len(n := x.size):
                    np.add.at(count, (x.token & np.uint64(counters - 1)).astype(np.int64), np.uint32(1))
                    row = np.asarray(rows)[x.text]
                    none = (pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.binary()), pa.nulls(len(n), pa.binary()))
                    yield pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array((x.line << 32) | (tkey[row] & 0xFFFFFFFF)), pa.array(x.name), *none], names=names)
        pieces = [(k, *_piece(c)) for k, c in enumerate(count.reshape(-1, min(counters, PIECE))) if c.any()]
        if pieces:
            place, used, larger = zip(*pieces)
            none = [pa.nulls(len(pieces), pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*none, pa.array(place, pa.int64()), pa.array(used, pa.binary()), pa.array(larger, pa.binary())], names=names)

    return run


def _piece(count: np.ndarray) -> tuple[bytes, bytes]:
    """A piece of the table of counters as bytes, and those that a byte can't hold."""
    used, large = np.flatnonzero(count), np.flatnonzero(count > 255)
    low = np.minimum(count, 255).astype(np.uint8)
    return low.tobytes() if 3 * len(used) >= len(count) else used.astype("<u2").tobytes() + low[used].tobytes(), np.concatenate([large.astype("<u4"), count[large].astype("<u4")]).tobytes()


def _summed(piece: int) -> Callable:
    """applyInPandas over one piece (of so many counters): a byte per counter, rising by 8 when the count doubles."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(piece, np.int64)
        for counts, larger in zip(pdf["counts"], pdf["larger"]):
            n = len(counts) // 3
            if len(counts) == piece:
                total += np.frombuffer(counts, np.uint8)
            else:
                total[np.frombuffer(counts, "<u2", n)] += np.frombuffer(counts, np.uint8, n, 2 * n)
            place, count = np.frombuffer(larger, "<u4").reshape(2, -1)
            total[place] += count.astype(np.int64) - 255
        level = np.minimum(255, 8 * np.log2(total + 1.0)).astype(np.uint8)
        return pd.DataFrame({"piece": pdf["piece"][:1], "levels": [level.tobytes()]})

    return run


def _levels(pieces: DataFrame, counters: int):
    """Broadcast table of commonness by token (``counters`` bytes, ``COUNTERS`` at most)."""
    piece = min(counters, PIECE)
    table = bytearray(counters)
    for r in pieces.groupBy("piece").applyInPandas(_summed(piece), "piece bigint, levels binary").collect():
        table[r["piece"] * piece : (r["piece"] + 1) * piece] = r["levels"]
    return pieces.sparkSession.sparkContext.broadcast(bytes(table))


def _short(key: np.ndarray) -> np.ndarray:
    """The 48 bits of a key that tell it apart within its range."""
    return key & np.uint64((1 << 48) - 1)


def _tied(packed: np.ndarray, size: np.ndarray, name: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The order by ``packed`` (sorted already), size, name and place: one sort by the front of the names, and again what that leaves equal."""
    if not len(packed) or (size >= 0xFFFF).any():  # packed numbers hold smaller sizes only
        return np.lexsort((at, name, size, packed))
    group = np.cumsum(np.append(False, packed[1:] != packed[:-1]))
    bits = max(1, int(group[-1]).bit_length())
    front = (group.astype(np.uint64) << np.uint64(64 - bits)) | ((name.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(bits))
    order = np.argsort(front)
    front = front[order]
    same = front[1:] == front[:-1]
    left = np.flatnonzero(np.append(same, False) | np.append(False, same))
    some = order[left]
    order[left] = some[np.lexsort((at[some], name[some], front[left]))]
    return order


def _sorted_entries(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries by key and size, each class of a key once and with its earliest place; their keys; their sizes)."""
    key, size = (x["key_b"].astype(np.uint64) << np.uint64(32)) | x["key"], (x["size"] & ~_OPEN).astype(np.int64)
    packed = (key << np.uint64(16)) | np.minimum(size, 0xFFFF).astype(np.uint64)
    order = np.argsort(packed)
    packed = packed[order]
    same = packed[1:] == packed[:-1]
    # only what the packed numbers leave equal is put in order by the rest
    tied = np.flatnonzero(np.append(same, False) | np.append(False, same)) if len(x) else np.zeros(0, np.int64)
    some = order[tied]
    order[tied] = some[_tied(packed[tied], size[some], x["name"][some], x["at"][some])]
    key, size, name = key[order], size[order], x["name"][order]
    new = np.ones(len(x), bool)
    new[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
    return x[order[new]], key[new], size[new]


def _by_part(part: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    """Entries as one row per range of keys."""
    order = np.sort((part << 32) | np.arange(len(part))) & 0xFFFFFFFF
    part, x = part[order], x.view("<u4").reshape(len(x), _ENTRY.itemsize // 4)[order]  # (rows of plain numbers are gathered faster than structs)
    at = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    return pa.RecordBatch.from_arrays([pa.array(part[at]), pa.array([x[a:b].tobytes() for a, b in zip(at, [*at[1:], len(x)])], pa.binary())], names=["part", "entries"])


def _salts(common: np.ndarray, hot: int) -> np.ndarray:
    """Over how many tasks a key is spread that may be too large for one."""
    return np.maximum(1, np.ceil(2.0 ** (common / 8.0) / hot)).astype(np.int64)


def _salted(short: np.ndarray, salt: np.ndarray, bits: int) -> np.ndarray:
    """The range that a salt of a key goes to."""
    with np.errstate(over="ignore"):
        return (mix(short + (salt.astype(np.uint64) + np.uint64(1)) * _ODD) >> np.uint64(64 - bits)).astype(np.int64)


def _place(doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """A hash of a line's place."""
    return shared.scatter(shared.scatter(doc).view(np.int64) ^ pos)


def _entries(percent: int, min_words: int, rare: int, wide: int, hot: int, levels, low: int, shift: int, bits: int, repeated, first_places) -> Callable:
    """mapInArrow over (doc, tkey, text): the entries (see ``_ENTRY``) of each range of keys, as bytes.

    Of the classes marked in ``repeated`` only the lines marked in ``first_places`` (the first ones, and few others) count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, names, places = (np.frombuffer(b.value, np.uint8) for b in (levels, repeated, first_places))
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def sent() -> pa.RecordBatch:
            part, x = (np.concatenate(c) for c in zip(*held))
            held.clear()
            return _by_part(part, x)

        for batch in batches:
            doc, tkey = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for rows, raws in _blocks(batch, 2):
                x = Lines(raws, min_words)
                if not len(x.size):
                    continue
                owner = np.asarray(rows)[x.text]
                pos = (x.line << 32) | (tkey[owner] & 0xFFFFFFFF)
                count = ~shared.marked(x.name.view(np.uint64), names, bits) | shared.marked(_place(doc[owner], pos), places, bits)
                key, row, lost, common = x.keys(level, percent, rare, wide)
                use = count[row]
                key, row, lost, common = key[use], row[use], lost[use], common[use]
                if not len(key):
                    continue
                out = np.zeros(len(key), _ENTRY)
                out["key"], out["key_b"], out["name"] = key & np.uint64(0xFFFFFFFF), (key >> np.uint64(32)) & np.uint64(0xFFFF), x.name[row]
                out["size"], out["lost"], out["bits"], out["common"] = x.size[row], np.minimum(lost, 255), x.parities()[row], common
                out["at"] = np.minimum((doc[owner[row]].view(np.uint64) - np.uint64(low)) >> np.uint64(shift), np.uint64(0xFFFFFFFF))
                # a key that may be too large for a task is dealt to several, none of which sees all of it in the first round
                salts = _salts(common, hot)
                part = (key >> np.uint64(64 - bits)).astype(np.int64)
                spread = np.flatnonzero(salts > 1)
                out["size"][spread] |= _OPEN
                part[spread] = _salted(_short(key[spread]), out["name"][spread] % salts[spread], bits)
                held.append((part, out))
                size += len(out)
                if size >= GATHER:
                    yield sent()
                    size = 0
        if held:
            yield sent()

    return run


def _looked_at_again(hot: int, bits: int, keys, names) -> Callable:
    """mapInArrow over stored (part, entries): those of the marked keys, by range; the marked classes are open and visit all ranges of their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_map, name_map = (np.frombuffer(b.value, np.uint8) for b in (keys, names))
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(blob.as_buffer(), _ENTRY)
                key = (x["key_b"].astype(np.uint64) << np.uint64(32)) | x["key"]
                use = shared.marked(shared.scatter(key.view(np.int64)), key_map, bits)
                x, key = x[use], key[use]
                if not len(x):
                    continue
                is_open = shared.marked(x["name"].view(np.uint64), name_map, bits)
                x["size"] = np.where(is_open, x["size"] | _OPEN, x["size"] & ~_OPEN)
                salts = _salts(x["common"], hot)
                spread = is_open & (salts > 1)
                many, parts = salts[spread], np.full(len(x), part, np.int64)
                salt = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                parts = np.concatenate([parts[~spread], _salted(np.repeat(key[spread], many), salt, bits)])
                yield _by_part(parts, np.concatenate([x[~spread], np.repeat(x[spread], many)]))

    return run


def _fit(bits: tuple[np.ndarray, ...], rest: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs that pass the positional and parity bounds, their distance); ``rest``: tokens that are not lost."""
    both = size[i] + size[j]
    need = -(-percent * both // (100 + percent))
    near = np.flatnonzero(np.minimum(rest[i], rest[j]) >= need)
    i, j, most = i[near], j[near], (both - 2 * need)[near]
    apart = np.zeros(len(i), np.int64)
    for b in bits:
        apart += np.bitwise_count(b[i] ^ b[j])
    ok = apart <= most
    return i[ok], j[ok], apart[ok]


def _candidates(percent: int, near: int, most: int, again: bool) -> Callable:
    """applyInPandas over the entries of one range of keys: name and name_b (an earlier class that may match), or with ``more`` name and a key that held more.

    In the first round each class meets its ``near`` neighbours by size in each key, and a last row has the entries of all keys that held more;
    later the open ones meet all of the key.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, key, size = _sorted_entries(np.concatenate([np.frombuffer(b, _ENTRY) for b in pdf["entries"]]))
        at, is_open = np.ascontiguousarray(x["at"]), x["size"] >= _OPEN
        rest, bits = size - x["lost"], tuple(np.ascontiguousarray(x["bits"][:, w]) for w in range(_WORDS))
        by_name = np.argsort(x["name"])
        number = np.empty(len(x), np.int64)  # the classes in the order of their names
        number[by_name] = np.cumsum(np.append(False, np.diff(x["name"][by_name]) != 0))
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        many = np.diff(np.append(begin, len(x)))
        begin, end = np.repeat(begin, many), np.repeat(begin + many, many)
        found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]
        more = np.zeros(len(x), bool)

        def closest() -> tuple[np.ndarray, ...]:
            """Of the pairs found so far the ``most`` closest of each class; ``more`` marks the keys of those left out."""
            i, j, apart = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((number[j], number[i] << 8 | apart)) if len(x) >= 1 << 27 else np.argsort(number[i] << 35 | apart << 27 | number[j])
            i, j, apart = i[order], j[order], apart[order]
            name, other = number[i], number[j]
            new = np.ones(len(name), bool)
            new[1:] = (name[1:] != name[:-1]) | (other[1:] != other[:-1])
            i, j, apart, name = (c[new] for c in (i, j, apart, name))
            first = np.flatnonzero(np.append(True, name[1:] != name[:-1])) if len(name) else np.zeros(0, np.int64)
            rank = np.arange(len(name)) - np.repeat(first, np.diff(np.append(first, len(name))))
            more[i[rank >= most]] = True
            return tuple(c[rank < most] for c in (i, j, apart))

        added = 0

        def add(*pairs: tuple[np.ndarray, ...]) -> None:
            nonlocal added
            found.extend(pairs)
            added += sum(len(p[0]) for p in pairs)
            if added > PAIRS:
                found[:] = [closest()]
                added = 0  # what is kept does not count, or a task of many classes would sort at every step

        if again:
            for i in np.flatnonzero(is_open).tolist():
                same = size[begin[i] : end[i]]
                j = begin[i] + np.arange(np.searchsorted(same, -(-percent * size[i] // 100)), np.searchsorted(same, 100 * size[i] // percent, "right"))
                j = j[(j != i) & (at[j] <= at[i])]
                add(_fit(bits, rest, size, np.full(len(j), i), j, percent))
        else:
            more |= is_open
            here = np.arange(len(x))
            for step in range(1, near + 2):
                here = here[here + step < end[here]]
                here = here[100 * size[here] >= percent * size[here + step]]
                if not len(here):
                    break
                there = here + step
                if step > near:
                    more[here] = more[there] = True
                    continue
                i, j, apart = _fit(bits, rest, size, here, there, percent)
                if len(i):
                    later, earlier = at[i] >= at[j], at[i] <= at[j]
                    add((i[later], j[later], apart[later]), (j[earlier], i[earlier], apart[earlier]))
        i, j, apart = closest()
        name, other = x["name"][i], x["name"][j]
        k = np.flatnonzero(more)
        whole = np.zeros(len(x), bool)
        whole[begin[k]] = not again
        last = int(whole.any())
        none, sizes = np.zeros(last, np.int64), (len(name), len(k), last)
        blank = np.repeat([True, True, False], sizes)
        held = np.full(len(blank), None, object)
        held[len(blank) - last :] = x[whole[begin]].tobytes()
        return pd.DataFrame({
            "name": np.concatenate([name, x["name"][k], none]), "apart": np.concatenate([apart, np.zeros(len(k), np.int64), none]).astype(np.int32), "name_b": np.concatenate([other, shared.scatter(key[k].view(np.int64)).view(np.int64), none]),
            "more": pd.arrays.BooleanArray(np.repeat([False, True, False], sizes), ~blank), "part": pd.arrays.IntegerArray(np.full(len(blank), int(pdf["part"].iloc[0])), blank), "entries": held,
        })

    return run


def _places(names, bits: int) -> Callable:
    """mapInArrow over (name, doc, pos): the places of the marked classes, whether marked rightly or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(names.value, np.uint8)
        for batch in batches:
            name, doc, pos = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            use = shared.marked(name.view(np.uint64), bitmap, bits)
            yield pa.RecordBatch.from_arrays([pa.array(_place(doc[use], pos[use]).view(np.int64))], names=["place"])

    return run


def _whole_sets(min_words: int, names, bits: int, holders, holder_bits: int) -> Callable:
    """mapInArrow over (doc, text): the whole sets of the marked classes, from the marked documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name_map, doc_map = (np.frombuffer(b.value, np.uint8) for b in (names, holders))
        for batch in batches:
            batch = batch.filter(pa.array(shared.marked(shared.scatter(batch.column(0).to_numpy(zero_copy_only=False)), doc_map, holder_bits)))
            found: dict[int, bytes] = {}
            for _, raws in _blocks(batch, 1):
                x = Lines(raws, min_words)
                if len(x.size):
                    for j in np.flatnonzero(shared.marked(x.name.view(np.uint64), name_map, bits)).tolist():
                        found[int(x.name[j])] = x.token[x.first[j] : x.first[j] + x.size[j]].tobytes()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], names=["name", "tokens"])

    return run


def _asked_sets(min_words: int) -> Callable:
    """mapInArrow over (asked, text): the whole sets of these classes (name, line), from those lines of the text; its other lines are not looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, texts = batch.column(0), batch.column(1).cast(pa.binary())
            many, each = asked.value_lengths().to_pylist(), asked.flatten()
            wanted, line = np.unique(each.field("name").to_numpy(zero_copy_only=False)), iter(each.field("line").to_pylist())
            some = []
            for i, n in enumerate(many):
                parts = (texts[i].as_py() or b"").split(b"\n")
                # another text under the same id may be shorter
                some.append(b"\n".join([parts[k] for k in islice(line, n) if k < len(parts)]))
            found: dict[int, bytes] = {}
            for _, raws in _blocks(pa.RecordBatch.from_arrays([pa.array(some, pa.binary())], names=["text"]), 0):
                x = Lines(raws, min_words)
                for j in np.flatnonzero(np.isin(x.name, wanted)).tolist():
                    found[int(x.name[j])] = x.token[x.first[j] : x.first[j] + x.size[j]].tobytes()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], names=["name", "tokens"])

    return run


def _verify(percent: int) -> Callable:
    """mapInArrow over (name, name_b, x, y): the pairs whose sets x and y reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def repeated_lines(docs: DataFrame, *, min_words: int = MIN_WORDS, percent: int = PERCENT, rare: int = RARE, wide: int = WIDE, hot: int = HOT, near: int = NEAR, sent: int = SENT, few: int = FEW, wanted: int = WANTED, listed_names: int = NAMES) -> DataFrame:
    """doc, tkey, lines (array of line numbers that go), per row of (doc, tkey, text) that has any."""
    texts = docs.select("doc", "text")
    known = F.when(F.col("doc") < NO_ID, F.col("doc"))
    total, low, high = docs.agg(F.sum(F.octet_length("text")), F.min(known), F.max(known)).first()
    total, low, high = total or 0, low or 0, high or 0
    bits = shared.range_bits(total // 24)
    counters = min(COUNTERS, 1 << max(16, (total // 48).bit_length()))
    stored = written(docs.select("doc", "tkey", "text").mapInArrow(_lines(min_words, counters), "doc bigint, pos bigint, name bigint, piece bigint, counts binary, larger binary"))
    levels = _levels(stored.filter("piece is not null").select("piece", "counts", "larger"), counters)
    lines = stored.filter("piece is null").select("doc", "pos", "name")
    firsts = written(lines.groupBy("name").agg(F.min(F.struct("doc", "pos")).alias("first"), F.count(F.lit(1)).alias("n")))

    several = firsts.filter("n > 1").count()
    repeated = shared.bitmap_of(firsts.filter("n > 1"), "name", bits, several)
    first_places = shared.bitmap_of(firsts.select("name", "first.doc", "first.pos").mapInArrow(_places(repeated, bits), "place bigint"), "place", bits, several)
    order = low % (1 << 64), max(0, (high - low).bit_length() - 32)

    def candidates(entries: DataFrame, again: bool, sent: int) -> DataFrame:
        return written(entries.groupBy("part").applyInPandas(_candidates(percent, near, sent, again), "name bigint, apart int, name_b bigint, more boolean, part bigint, entries binary"))

    def whole_sets(names: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(name, first) and (name, tokens, first) of these classes."""
        if names.count() <= listed_names:
            needed = cut(firsts.select("name", "first").join(F.broadcast(names), "name"))
            asked = needed.groupBy(F.col("first.doc").alias("doc")).agg(F.collect_list(F.struct("name", F.shiftright("first.pos", 32).alias("line"))).alias("asked"))
            read = texts.join(F.broadcast(asked), "doc").select("asked", "text").mapInArrow(_asked_sets(min_words), "name bigint, tokens binary")
            return needed, written(read.dropDuplicates(["name"]).join(needed, "name"))
        known = shared.rows_of(firsts.select("name", "first"), names)
        needed = cut(names.join(known, "name"))
        shared.forget(known)
        chosen = shared.bitmap_of(needed, "name", bits)
        holders = shared.ids_bitmap(needed.select(F.col("first.doc").alias("doc")), 8)
        # (one Python function reads the texts: a chain of two would hold twice the workers)
        sets = written(texts.mapInArrow(_whole_sets(min_words, chosen, bits, holders, 8), "name bigint, tokens binary").dropDuplicates(["name"]).join(needed, "name"))
        holders.destroy()
        chosen.destroy()
        return needed, sets

    def matched(pairs: DataFrame) -> DataFrame:
        """(name): the classes with a match whose first line is earlier."""
        needed, sets = whole_sets(cut(pairs.select(F.explode(F.array("name", "name_b")).alias("name")).distinct()))
        both = pairs.join(sets.select("name", F.col("tokens").alias("x")), "name").join(sets.select(F.col("name").alias("name_b"), F.col("tokens").alias("y")), "name_b")
        true = both.select("name", "name_b", "x", "y").mapInArrow(_verify(percent), "name bigint, name_b bigint")
        late = true.join(needed.withColumnRenamed("first", "f"), "name").join(needed.select(F.col("name").alias("name_b"), F.col("first").alias("g")), "name_b")
        done = cut(late.select(F.when(F.col("f") > F.col("g"), F.col("name")).otherwise(F.col("name_b")).alias("name")).distinct())
        discard(sets)
        return done

    def decided(sent_: DataFrame, waiting: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
        """(name): the classes that a candidate of the round, or one that waits, matches, by all of them if they are few, or else by the closest one; the other pairs of the undecided classes, which wait for the next look at the texts."""
        pairs = sent_.filter("not more").select("name", "apart", "name_b")
        if waiting is not None:  # a pair was found in several keys
            pairs = cut(pairs.unionByName(waiting).distinct())
        if pairs.count() <= few:
            return matched(pairs.select("name", "name_b").distinct()), None
        best = cut(pairs.groupBy("name").agg(F.min(F.struct("apart", "name_b")).alias("x")).select("name", "x.name_b"))
        done = matched(best)
        others = cut(without(pairs, done).distinct().join(best, ["name", "name_b"], "left_anti"))
        return done, None if others.isEmpty() else others

    def without(rows: DataFrame, names: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(names) if names.count() <= listed_names else names, "name", "left_anti")

    release(docs.sparkSession)  # the shuffles so far, before the largest one
    entries = docs.select("doc", "tkey", "text").mapInArrow(_entries(percent, min_words, rare, wide, hot, levels, *order, bits, repeated, first_places), "part bigint, entries binary")
    first_round = round_ = candidates(entries, False, sent)
    del entries
    release(docs.sparkSession)
    held = first_round.filter("more is null").select("part", "entries")
    late, waiting = decided(round_, None)
    while True:
        left = cut(without(round_.filter("more").select("name", F.col("name_b").alias("key")), late).distinct())
        if round_ is not first_round:
            discard(round_)
        still = left.select("name").distinct().count()
        if not still:
            break
        # a few classes may send so many that no further round is needed
        sent = max(16 * sent, wanted // still)
        marks = shared.bitmap_of(left, "key", bits), shared.bitmap_of(left, "name", bits)
        round_ = candidates(held.mapInArrow(_looked_at_again(hot, bits, *marks), "part bigint, entries binary"), True, sent)
        for mark in marks:
            mark.destroy()
        done, waiting = decided(round_, waiting)
        late = cut(late.unionByName(done).distinct())
    if waiting is not None:
        late = cut(late.unionByName(matched(waiting.select("name", "name_b"))).distinct())
    discard(first_round)
    # only the lines of classes with several lines or an earlier match are joined
    listed = late.withColumn("late", F.lit(True))
    known = single = members = None
    if late.count() <= listed_names:
        known = firsts.join(F.broadcast(listed), "name", "left").filter(F.col("late") | (F.col("n") > 1)).select("name", "first", "late")
    else:
        single = shared.rows_of(firsts.filter("n = 1").select("name", "first"), late)
        known = firsts.filter("n > 1").select("name", "first").unionByName(single).join(listed, "name", "left")
    some = cut(known)
    if single is not None:
        shared.forget(single)
    if some.count() <= listed_names:
        held = lines.join(F.broadcast(some), "name")
    else:
        members = shared.rows_of(lines.select("name", "doc", "pos"), some.select("name"))
        held = members.join(some, "name")
    gone = held.filter(F.col("late") | (F.struct("doc", "pos") != F.col("first")))
    spans = written(gone.groupBy("doc", F.col("pos").bitwiseAND(0xFFFFFFFF).alias("tkey")).agg(F.collect_list(F.shiftright("pos", 32)).alias("lines")))
    if members is not None:
        shared.forget(members)
    for sent_out in (levels, repeated, first_places):
        sent_out.destroy()
    discard(stored)
    discard(firsts)
    return spans


def _without(text: Column, lines: Column) -> Column:
    """The text without the lines of these numbers; DataFrame functions, as a second Python step in the stage that picks the texts would hold twice the workers."""
    parts = F.split(text, "\n")
    kept = F.filter(parts, lambda part, i: ~F.array_contains(lines, i.cast("bigint")))
    # a long list would be searched for every line; one split a text: the inner function sees its parts as a variable
    many = F.transform(F.array(parts), lambda p: F.transform(F.array_except(F.sequence(F.lit(0).cast("bigint"), F.size(p).cast("bigint") - 1), lines), lambda i: p[i]))[0]
    return F.array_join(F.when(F.size(lines) <= SHORT, kept).otherwise(many), "\n")


def remove_similar_lines(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str, str] = ("text", "n_lines", "n_removed"), listed: int = LISTED, **options) -> DataFrame:
    """``keep`` columns and, as ``names``, the text of the lines that stay (joined by a line end), the lines it had and those that went.

    No text is shuffled while the list of lines that go takes at most ``listed`` bytes; beyond, only texts that lose a line are.
    """
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))
    rows = docs.select(doc.alias("doc"), F.xxhash64("text").alias("tkey"), "text", shared.packed(keep).alias("kept"))
    with small_batches(docs.sparkSession):
        gone = repeated_lines(rows.select("doc", "tkey", "text"), **options)
    texts, many = gone.agg(F.count(F.lit(1)), F.sum(F.size("lines"))).first()
    if 80 * texts + 8 * (many or 0) <= listed:
        touched, others, spans = rows, None, F.broadcast(gone.withColumnRenamed("tkey", "short"))
    else:
        (touched, others), spans = shared.parted(rows, gone.select("doc")), gone.withColumnRenamed("tkey", "short")
    joined = touched.join(spans, (touched["doc"] == spans["doc"]) & (F.col("tkey").bitwiseAND(0xFFFFFFFF) == F.col("short")), "left").select("kept", "text", "lines")
    ends = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    many = F.when(F.col("text").isNull(), 0).otherwise(ends + 1).cast("bigint")
    left = F.when(F.col("lines").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("lines")))
    n_gone = F.when(F.col("lines").isNull(), 0).otherwise(F.size(F.array_distinct("lines"))).cast("bigint")
    done = joined.select("kept", left.alias("text"), many.alias("n_lines"), n_gone.alias("n_removed"))
    if others is not None:
        done = done.unionByName(others.select("kept", "text", many.alias("n_lines"), F.lit(0).cast("bigint").alias("n_removed")))
    return done.select(*shared.unpacked("kept", keep), *[F.col(a).alias(b) for a, b in zip(("text", "n_lines", "n_removed"), names)])


def dedup_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text (without the lines that go), n_lines, n_removed."""
    return remove_similar_lines(docs)
