"""Passages of evaluation items inside a corpus.

Method: suffix arrays. The corpus is cut into shards of whole documents; each shard's words become numbers, its suffixes are
sorted by prefix doubling, and all suffixes of all test passages are looked up together by binary search over the sorted
suffixes. Places that share the asked number of words are followed on to their longest verbatim match. Test items go to every
task in blocks of a bounded size, one pass over the corpus each; nothing of the corpus goes to the driver.

Words are the longest runs of letters and digits after NFKC and lower-casing. A document leaks an item if it shares a run of
at least `min_words` words with the prompt or with the answer, or holds a whole prompt that is shorter.

Defined results: null and empty texts hold nothing; an item whose prompt has no words matches through its answer only; a
document or an item that occurs twice is reported as often as it has different ids; rows with a null id are not reported, but
`without_leaks` removes them all the same; ids keep their types; empty tables give an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..staging import Stage

_WORD = regex.compile(r"[\p{L}\p{N}]+")
SHARD_WORDS = 2_000_000
BLOCK_CHARS = 10_000_000  # characters of test passages that go to the tasks at a time


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(unicodedata.normalize("NFKC", text).lower()) if text else []


class Passages:
    """Test passages as numbers. Numbers from 1 on are words, in order; 0 ends a document or is a word of no passage."""

    def __init__(self, items: list[tuple[object, str | None, str | None]], min_words: int):
        seqs = [(k, 0, words_of(p)) for k, (_, p, _) in enumerate(items)] + [(k, 1, words_of(a)) for k, (_, _, a) in enumerate(items)]
        seqs = [(k, w) for k, part, w in seqs if (len(w) >= min_words or part == 0) and w]
        self.ids = [i for i, _, _ in items]
        self.number = {x: n + 1 for n, x in enumerate(sorted({x for _, w in seqs for x in w}))}
        #: all passages one after the other, each ended by a 0
        self.text = np.array([self.number[x] if x else 0 for _, w in seqs for x in [*w, ""]], np.int64)
        size = np.array([len(w) for _, w in seqs], np.int64)
        # a passage shorter than min_words must match whole; of others every suffix that is long enough counts
        count = np.maximum(size - min_words, 0) + 1
        start = np.cumsum(size + 1) - size - 1
        which = np.repeat(np.arange(len(seqs)), count)
        self.at = start[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) if len(seqs) else np.zeros(0, np.int64)
        self.need = np.minimum(size, min_words)[which] if len(seqs) else self.at
        self.item = np.array([k for k, _ in seqs], np.int64)[which] if len(seqs) else self.at

    @property
    def depth(self) -> int:
        return int(self.need.max(initial=1))


class SuffixArray:
    """Suffixes of one shard in order, by their first `depth` words. Suffixes that begin with a 0 are left out: no passage
    does."""

    def __init__(self, text: np.ndarray, depth: int):
        self.text = np.append(text, np.zeros(depth + 1, np.int64))
        n = len(text)
        zeros = np.flatnonzero(text == 0)
        ends = np.append(zeros, n)[np.searchsorted(zeros, np.arange(n))]
        rank = text.copy()
        at = np.flatnonzero(text)
        have = 1
        while have < depth and len(at):
            # order by (rank of the first half, rank of the second half); a 0 in between ends the suffix
            second = np.zeros(len(at), np.int64)
            going = ends[at] - at > have
            second[going] = rank[at[going] + have]
            _, new = np.unique(rank[at] * (int(rank.max()) + 1) + second, return_inverse=True)
            rank = np.zeros(n, np.int64)
            rank[at] = new + 1
            have *= 2
        self.order = at[np.argsort(rank[at], kind="stable")]

    def find(self, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, last + 1) place in the order of the suffixes that begin with each row's words; all rows are searched
        together."""
        bounds = []
        for after in (False, True):
            lo, hi = np.zeros(len(suffixes), np.int64), np.full(len(suffixes), len(self.order), np.int64)
            live = np.flatnonzero(lo < hi)
            while len(live):
                mid = (lo[live] + hi[live]) // 2
                place, sign = self.order[mid], np.zeros(len(live), np.int64)
                for k in range(suffixes.shape[1]):
                    same = np.flatnonzero(sign == 0)
                    sign[same] = np.sign(self.text[place[same] + k] - suffixes[live[same], k])
                up = (sign < 0) | (after & (sign == 0))
                lo[live[up]], hi[live[~up]] = mid[up] + 1, mid[~up]
                live = live[lo[live] < hi[live]]
            bounds.append(lo)
        return bounds[0], bounds[1]


def shard_matches(passages: Passages, docs: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """(document's place in the shard, item's place, longest match in words) of a shard; docs are numbered words."""
    lengths = np.array([len(d) + 1 for d in docs], np.int64)
    starts = np.cumsum(lengths) - lengths
    text = np.zeros(int(lengths.sum()), np.int64)
    for s, d in zip(starts, docs):
        text[s : s + len(d)] = d
    array = SuffixArray(text, passages.depth)
    found = [np.zeros((0, 3), np.int64)]
    for need in np.unique(passages.need):
        of = np.flatnonzero(passages.need == need)
        first, last = array.find(passages.text[passages.at[of][:, None] + np.arange(need)])
        n = last - first
        rows = np.repeat(of, n)
        place = array.order[np.repeat(first, n) + np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)]
        shared = np.full(len(rows), need)
        live = np.arange(len(rows))
        while len(live):  # on to the longest match
            mine, test = array.text[np.minimum(place[live] + shared[live], len(array.text) - 1)], passages.text[passages.at[rows[live]] + shared[live]]
            live = live[(mine == test) & (test != 0)]
            shared[live] += 1
        found.append(np.stack([np.searchsorted(starts, place, side="right") - 1, passages.item[rows], shared], axis=1))
    all_found = np.concatenate(found)
    all_found = all_found[np.lexsort((-all_found[:, 2], all_found[:, 1], all_found[:, 0]))]
    fresh = np.ones(len(all_found), bool)
    fresh[1:] = (all_found[1:, :2] != all_found[:-1, :2]).any(axis=1)
    return [tuple(r) for r in all_found[fresh].tolist()]


def leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", prompt: str = "prompt", answer: str = "answer", min_words: int = 12, shard_words: int = SHARD_WORDS, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """(doc_id, item_id, matched_words): documents that hold passages of an item, with the longest run they share."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return _search(rows.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()), items, item_id, prompt, answer, min_words, shard_words, block_chars)


def _search(rows: DataFrame, items: DataFrame, item_id: str, prompt: str, answer: str, min_words: int, shard_words: int, block_chars: int) -> DataFrame:
    spark = rows.sparkSession
    tests = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{prompt}`").alias("p"), F.col(f"`{answer}`").alias("a")).filter(F.col("item_id").isNotNull())
    chars = F.coalesce(F.length("p"), F.lit(0)) + F.coalesce(F.length("a"), F.lit(0)) + 1
    size = tests.agg(F.coalesce(F.sum(chars), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * size // block_chars)) if size > block_chars else 1
    types = rows.schema["doc_id"].dataType, tests.schema["item_id"].dataType
    out = None
    for k in range(blocks):  # one block unless there are very many items
        some = tests.filter(F.pmod(F.xxhash64("item_id", "p", "a"), F.lit(blocks)) == k) if blocks > 1 else tests
        one = _pass(rows, spark.sparkContext.broadcast([tuple(r) for r in some.collect()]), types, min_words, shard_words)
        out = one if out is None else out.unionByName(one)
    return out.groupBy("doc_id", "item_id").agg(F.max("matched_words").alias("matched_words"))


def _pass(rows: DataFrame, shared, types: tuple, min_words: int, shard_words: int) -> DataFrame:
    """One pass over the corpus for one block of items."""
    arrow = [to_arrow_type(t) for t in types]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = Passages(shared.value, min_words)
        number = passages.number.get
        ids: list = []
        held: list[np.ndarray] = []
        n = 0

        def out() -> pa.RecordBatch:
            found = shard_matches(passages, held) if len(passages.at) and held else []
            cols = [[ids[d] for d, _, _ in found], [passages.ids[i] for _, i, _ in found], [m for _, _, m in found]]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], arrow[0]), pa.array(cols[1], arrow[1]), pa.array(cols[2], pa.int32())], ["doc_id", "item_id", "matched_words"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(t)
                w = np.fromiter((number(x, 0) for x in words), np.int64, len(words))
                if not w.any():
                    continue
                # words of no passage only separate: one of them between others is enough
                keep = w != 0
                keep[1:] |= keep[:-1]
                ids.append(i)
                held.append(w[keep])
                n += len(held[-1]) + 1
                if n >= shard_words:
                    yield out()
                    ids, held, n = [], [], 0
        yield out()

    schema = T.StructType([T.StructField("doc_id", types[0]), T.StructField("item_id", types[1]), T.StructField("matched_words", T.IntegerType())])
    return rows.mapInArrow(run, schema)


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", prompt: str = "prompt", answer: str = "answer", min_words: int = 12, shard_words: int = SHARD_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no passage of any item. Whether a document leaks follows from its text alone, so texts that
    leak are named by a digest of theirs, and documents without an id are removed too."""

    def digest(c: Column) -> Column:
        return F.sha2(c, 256)

    body = F.col(f"`{text}`").cast("string")
    found = _search(docs.select(digest(body).alias("doc_id"), body.alias("text")).filter("text is not null"), items, item_id, prompt, answer, min_words, shard_words, block_chars)
    bad = Stage(docs.sparkSession, "leaks").write(found.select(F.col("doc_id").alias("__bad")).distinct())
    return docs.join(bad, digest(body) == F.col("__bad"), "left_anti")
