"""Spelling variants: words one edit apart, found in a frequency-vector trie.

A word is arranged by how often each group of letters stands in it, one trie level per
group of ``LEVELS``.  One inserted, deleted or replaced letter adds at most one to one
count (a surplus) and takes at most one from another (a deficit), so a search that walks
down the trie may leave a word's own counts by one surplus and one deficit in all.

The first ``TOP`` levels deal the trie to tasks: a word goes to the subtree of its own
counts and, with its deficit spent, to the subtree of each count lowered by one.  Two
words one edit apart share exactly one subtree (that of the counts they have in common),
so each pair is found once and a word is sent some seven times whatever the vocabulary.
A task walks its subtrees depth-first, all words of a subtree as searches at once, and
verifies the words of the leaves that are left.

Edge cases: null and empty texts have no words; a null id is written as nothing before
the colon; repeated rows count as often as they stand; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweave.session import cut

#: Letters of each level but the last ones, which take all other letters by their code (fixed values).
LETTERS = ("e", "a", "i", "n", "r", "s", "t", "o", "l", "u", "d", "c", "m", "p", "g", "h", "b", "f", "v", "ky", "jqwxz")
OTHERS = 3
LEVELS = len(LETTERS) + OTHERS
#: Levels by which the trie is dealt to tasks.
TOP = 12
#: Words of a node whose counts are compared at once, without walking further.
LEAF = 48
#: Rows after which a task works off the subtrees it has read, and comparisons at once.
BLOCK, CELLS = 20_000, 100_000

#: Level of each of the 256 letters.
_LEVEL = np.array([next((k for k, group in enumerate(LETTERS) if chr(c) in group), len(LETTERS) + c % OTHERS) for c in range(256)])


def word_counts(docs: DataFrame, *, every: int = 199, shortest: int = 6, least: int = 5) -> DataFrame:
    """(word, n): the words of all texts; in one run of ``every``, chosen by a checksum of id and run, a letter is missing."""
    letters = F.regexp_extract_all("text", F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0))
    lower = lambda x: F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = F.transform(F.filter(letters, lambda x: F.length(x) >= shortest), lower)
    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    run = run.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return run.select(word.alias("word")).filter(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def _times(word: Column, letters: str) -> Column:
    return F.length(word) - F.length(F.translate(word, letters, ""))


def dealt(words: DataFrame, top: int = TOP) -> DataFrame:
    """(subtree, mark, word, n): each word under its own counts (mark 0) and, for each level in use, under that count lowered by one (mark: the level from 1)."""
    counted = words.select("word", "n", F.array(*[_times(F.col("word"), x) for x in LETTERS[:top]]).alias("counts"))
    lowered = F.filter(F.sequence(F.lit(0), F.lit(top)), lambda k: (k == 0) | (F.get("counts", k - 1) > 0))
    marks = counted.select("word", "n", "counts", F.explode(lowered).alias("mark"))
    path = F.transform("counts", lambda c, k: F.when(k == F.col("mark") - 1, c - 1).otherwise(c))
    return marks.select(F.array_join(path, ",").alias("subtree"), "mark", "word", "n")


def one_edit(a: str, b: str) -> bool:
    """Whether the words differ by exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def letter_counts(words: list[str]) -> np.ndarray:
    """One row per word, one column per level."""
    raw = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.bincount(row * LEVELS + _LEVEL[raw], minlength=len(words) * LEVELS).reshape(len(words), LEVELS).astype(np.int32)


def _leaf(rows: np.ndarray, lo: int, hi: int, level: int, query: np.ndarray, plus: np.ndarray, minus: np.ndarray) -> Iterator[tuple[int, int]]:
    """(search, word) pairs of a node whose remaining counts stay within the budgets, the search before the word."""
    step = max(1, CELLS // ((hi - lo) * max(1, rows.shape[1] - level)))
    for at in range(0, len(query), step):
        q = query[at : at + step]
        ahead = rows[None, lo:hi, level:] - rows[q, None, level:]
        over, under = np.maximum(ahead, 0).sum(2), np.maximum(-ahead, 0).sum(2)
        ok = (over <= plus[at : at + step, None]) & (under <= minus[at : at + step, None]) & (q[:, None] < np.arange(lo, hi)[None, :])
        a, b = np.nonzero(ok)
        yield from zip(q[a].tolist(), (b + lo).tolist())


def search(rows: np.ndarray, marks: np.ndarray, lo: int, hi: int, leaf: int = LEAF) -> Iterator[tuple[int, int]]:
    """Candidate pairs of one subtree: ``rows`` are its words' counts in the order of (mark, counts).

    A marked word has spent its deficit on the way here: seen from an unmarked one it is one letter ahead.
    Two of one mark are left to the subtree where they are unmarked.
    """
    all_ = np.arange(lo, hi)
    open_ = []
    for mark in np.unique(marks[lo:hi]):
        first, last = lo + np.searchsorted(marks[lo:hi], mark), lo + np.searchsorted(marks[lo:hi], mark, "right")
        query = all_ if mark == 0 else all_[marks[lo:hi] != mark]
        open_.append((first, last, 0, query, np.full(len(query), 1 - (mark > 0)), 1 - (marks[query] > 0)))
    while open_:
        lo, hi, level, query, plus, minus = open_.pop()
        query, plus, minus = (x[query < hi] for x in (query, plus, minus))
        if not len(query):
            continue
        if hi - lo <= leaf or level == rows.shape[1]:
            yield from _leaf(rows, lo, hi, level, query, plus, minus)
            continue
        here = rows[lo:hi, level]
        cuts = np.append(np.flatnonzero(np.append(True, here[1:] != here[:-1])), hi - lo)
        own = rows[query, level]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            ahead = here[a] - own
            ok = (ahead == 0) | ((ahead == 1) & (plus > 0)) | ((ahead == -1) & (minus > 0))
            open_.append((lo + a, lo + b, level + 1, query[ok], plus[ok] - (ahead[ok] == 1), minus[ok] - (ahead[ok] == -1)))


def _found(table: pa.Table) -> pa.RecordBatch:
    """Near pairs of whole subtrees, both ways."""
    words, n = np.array(table["word"].to_pylist(), object), table["n"].to_numpy()
    subtree = np.unique(np.array(table["subtree"].to_pylist(), object), return_inverse=True)[1]
    marks, counts = table["mark"].to_numpy(), letter_counts(words.tolist())[:, TOP:]
    order = np.lexsort((*counts.T[::-1], marks, subtree))
    words, n, subtree, marks, counts = words[order], n[order], subtree[order], marks[order], counts[order]
    bounds = np.append(np.flatnonzero(np.append(True, subtree[1:] != subtree[:-1])), len(words))
    left, right = [], []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if hi - lo > 1:
            for a, b in search(counts, marks, lo, hi):
                if one_edit(words[a], words[b]):
                    left.append(a)
                    right.append(b)
    one, two = np.array(left + right, int), np.array(right + left, int)
    return pa.RecordBatch.from_arrays([pa.array(words[one], pa.string()), pa.array(words[two], pa.string()), pa.array(n[two], pa.int64())], names=["word", "near", "near_n"])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over rows sorted by subtree: whole subtrees at a time, never the whole partition."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < BLOCK:
            continue
        table = pa.Table.from_batches(held)
        last = table["subtree"][-1].as_py()
        names = table["subtree"].to_pylist()
        whole = names.index(last)  # sorted: rows before the last subtree are complete
        if whole:
            yield _found(table.slice(0, whole).combine_chunks())
            table = table.slice(whole).combine_chunks()
        held, size = table.to_batches(), table.num_rows
    if size:
        yield _found(pa.Table.from_batches(held).combine_chunks())


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every word with each word one edit away, both ways."""
    rows = dealt(words).repartition("subtree").sortWithinPartitions("subtree")
    return rows.mapInArrow(_search, "word string, near string, near_n bigint")


def spelling_groups(docs: DataFrame, *, factor: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n: every word of the texts with the near word it is a variant of.

    The form is the most frequent near word (of several, the first in code-point order) if it is at
    least ``factor`` times as frequent; the root is where forms lead in the end.  Counts grow
    ``factor``-fold with each form, so five doublings reach the root of any 64-bit count.
    """
    words = cut(word_counts(docs))
    best = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    near_n = -F.col("best.m")
    is_form = near_n >= factor * F.col("n")
    formed = cut(joined.select("word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(is_form, near_n).alias("form_n")))
    step = formed.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(5):
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = cut(step.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if step.filter("moved").isEmpty():
            break
        step = step.drop("moved")
    return formed.join(step.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
