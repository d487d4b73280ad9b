"""Texts over a token limit cut into pieces at natural boundaries, each piece repeating the end of the one before.

A cut lies after a token. From a cut the next one is the farthest legal successor: the farthest sentence, line or paragraph
end that keeps the piece (with its overlap) within the limit; where there is none, the farthest word end; where there is
none either, the limit itself. Every boundary is joined to its successor in one windowed pass, and pointer doubling squares
that table: after i joins the cuts within 2^i steps of the start are known, for all documents at once.

Defined results: a null or empty text has no pieces; a text within the limit is one piece; each input row is cut for itself,
also where ids are null or occur twice; texts are cut whole, however long; a cut inside of a character (only possible at the
limit itself) gives U+FFFD in the texts of the pieces, never in their token ids; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import Stage, lookup
from .bpe import MEMO_CHARS, MEMO_SEGMENTS, SEGMENT, Decoder, Vocabulary, loaded, uncollected
from .encode import VOCABULARY, list_array, shared_vocabulary

WORD, SENTENCE = 1, 2
_SENTENCE_END = regex.compile(r"[\n\r]\s*$|[.!?…]['\"»”’)\]]*\s*$|[。！？]['\"」』）]*\s*$")


def _segment_cuts(v: Vocabulary, text: str) -> tuple[int, list[int], list[tuple[int, int]], bool]:
    """(number of ids, ids, boundaries within as (tokens before, kind), whether a sentence ends with it) of one segment."""
    ids: list[int] = []
    inner: list[tuple[int, int]] = []
    before = ""
    for w in v.words.findall(text):
        at, blank = len(ids), w[0].isspace()
        if at and (blank or before[-1].isspace() or before[-1] in "。！？"):
            if blank and w.isspace() and not before.isspace():
                pass  # blanks stay with what they follow
            elif (blank or before[-1] in "\n\r。！？" or before.isspace()) and _SENTENCE_END.search(before):
                inner.append((at, SENTENCE))
            elif w[0] == " " or before.isspace():
                inner.append((at, WORD))
        ids.extend(v.memo.get(w) or v.word(w))
        before = before + w if blank and w.isspace() and not before.isspace() else w
    return len(ids), ids, inner, not before[-1:].isalnum() and bool(_SENTENCE_END.search(before))


def _cuts_of(v: Vocabulary, s: str) -> tuple[int, list[int], list[tuple[int, int]], bool]:
    known = v.cuts.get(s)
    if known is None:
        known = _segment_cuts(v, " " + s)
        if len(s) <= MEMO_CHARS:
            if len(v.cuts) >= MEMO_SEGMENTS:
                v.cuts.clear()
            v.cuts[s] = known
    return known


def cut_points(v: Vocabulary, text: str, step: int, limit: int = 0, with_ids: bool = True) -> tuple[int, list[int], list[int], list[int]]:
    """(number of tokens, ids, places, kinds): the natural boundaries of a text as numbers of tokens before them, none for
    a text within the limit. Word ends are given only between sentence ends more than `step` apart, since no cut can use
    others. A segment that follows a blank begins at a sentence end or at a word end, whatever is in it."""
    first, *rest = SEGMENT.split(text)
    get = v.cuts.get
    parts = [_segment_cuts(v, first), *[get(s) or _cuts_of(v, s) for s in rest]]
    n = sum([p[0] for p in parts])
    ids = [i for p in parts for i in p[1]] if with_ids else []
    if n <= limit or not n:
        return n, ids, [], []
    places, kinds = [0], [SENTENCE]
    words: list[int] = []

    def sentence_end(at: int) -> None:
        if at - places[-1] > step:
            places.extend(words)
            kinds.extend([WORD] * len(words))
        words.clear()
        places.append(at)
        kinds.append(SENTENCE)

    at, ended = 0, False
    for size, _, inner, ends in parts:
        if at:
            if not ended:
                words.append(at)
            elif at != places[-1]:
                sentence_end(at)
        for k, kind in inner:
            if kind == WORD:
                words.append(at + k)
            elif at + k != places[-1]:
                sentence_end(at + k)
        at += size
        ended = ends
    sentence_end(n)
    return n, ids, places[1:], kinds[1:]


def tokens_with_cuts(docs: DataFrame, doc_id: str, text: str, limit: int, overlap: int, vocabulary: str, with_ids: bool) -> DataFrame:
    """(doc_id, n_tokens, ids, cuts): cuts of texts over the limit only; ids null if they are not asked for."""
    shared = shared_vocabulary(docs.sparkSession, vocabulary)
    step = limit - overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = loaded(*shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                counts, ids, places, kinds = [], [], [], []
                with uncollected():
                    for t in part.column(1).to_pylist():
                        for column, value in zip((counts, ids, places, kinds), cut_points(v, t, step, limit, with_ids) if t else (0, [], [], [])):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int32()), list_array(ids), list_array(places), list_array(kinds)],
                    ["doc_id", "n_tokens", "ids", "places", "kinds"],
                )

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType(
        [T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n_tokens", T.IntegerType())]
        + [T.StructField(c, ints) for c in ("ids", "places", "kinds")]
    )
    return rows.mapInArrow(run, schema)


def pieces(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = 512, overlap: int = 48, vocabulary: str = VOCABULARY, with_text: bool = True
) -> DataFrame:
    """(doc_id, piece_no, n_pieces, start, stop[, ids, text]): pieces as token ranges of their documents."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    spark, step = docs.sparkSession, limit - overlap
    stage = Stage(spark, "pieces")
    tokens = tokens_with_cuts(docs, doc_id, text, limit, overlap, vocabulary, with_text)
    tokens = stage.write(tokens.withColumn("row", F.monotonically_increasing_id()))
    long = tokens.filter(F.col("n_tokens") > limit)
    natural = long.select("row", "n_tokens", F.explode(F.arrays_zip("places", "kinds")).alias("c")).select("row", F.col("c.places").alias("at"), F.col("c.kinds").alias("kind"))
    # the start counts as a cut that lies `overlap` tokens in, so that the first piece begins at 0
    natural = natural.filter(F.col("at") > overlap).unionByName(long.select("row", F.lit(overlap).alias("at"), F.lit(WORD).alias("kind")))
    order = Window.partitionBy("row").orderBy("at")
    gap = F.lead("at").over(order) - F.col("at")
    forced = natural.select("row", "at", gap.alias("gap")).filter(F.col("gap") > step)
    forced = forced.select("row", F.explode(F.sequence(F.col("at") + step, F.col("at") + F.col("gap") - 1, F.lit(step))).alias("at"), F.lit(0).alias("kind"))
    reach = order.rangeBetween(1, step)
    best = F.coalesce(
        F.max(F.when(F.col("kind") == SENTENCE, F.col("at"))).over(reach), F.max(F.when(F.col("kind") == WORD, F.col("at"))).over(reach), F.max("at").over(reach)
    )
    jump, n_jump = stage.write_counted(natural.unionByName(forced).select("row", "at", best.alias("next")).filter(F.col("next").isNotNull()))
    jump = jump.select(F.struct("row", "at").alias("key"), "next")
    reached, n = stage.write_counted(long.select("row", F.lit(overlap).alias("at")))
    while n:
        step_on = lookup(reached.select(F.struct("row", "at").alias("key")), n, "key", jump, n_jump).select("key.row", F.col("next").alias("at"))
        more, n_more = stage.write_counted(reached.unionByName(step_on).distinct())
        if n_more == n:
            break
        squared = lookup(
            jump.select("key", F.struct(F.col("key.row").alias("row"), F.col("next").alias("at")).alias("via")), n_jump, "via",
            jump.select(F.col("key").alias("via"), F.col("next").alias("far")), n_jump,
        ).select(F.col("key.row").alias("row"), F.col("key.at").alias("at"), F.col("far").alias("next"))
        squared, n_jump = stage.write_counted(squared)
        jump, reached, n = squared.select(F.struct("row", "at").alias("key"), "next"), more, n_more
    cuts = reached.withColumn("to", F.lead("at").over(order)).filter(F.col("to").isNotNull())
    cuts = cuts.select("row", (F.col("at") - overlap).alias("start"), F.col("to").alias("stop"), (F.row_number().over(order) - 1).alias("piece_no"))
    whole = tokens.filter((F.col("n_tokens") > 0) & (F.col("n_tokens") <= limit)).select("row", F.lit(0).alias("start"), F.col("n_tokens").alias("stop"), F.lit(0).alias("piece_no"))
    cut = cuts.unionByName(whole).withColumn("n_pieces", F.count("*").over(Window.partitionBy("row")).cast("int"))
    out = cut.join(tokens.select("row", "doc_id", *(["ids"] if with_text else [])), "row")
    if not with_text:
        return out.select("doc_id", "piece_no", "n_pieces", "start", "stop")
    out = out.select("doc_id", "piece_no", "n_pieces", "start", "stop", F.slice("ids", F.col("start") + 1, F.col("stop") - F.col("start")).alias("ids"))
    shared = shared_vocabulary(spark, vocabulary)

    @F.pandas_udf("string")
    def text_of(ids):
        v = loaded(*shared.value)

        def one(x) -> str:
            d = Decoder(v)
            return d.feed(x.tolist()) + d.finish()

        return ids.map(one)

    return out.withColumn("text", text_of("ids"))
