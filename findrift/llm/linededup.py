"""Repeated passages by winnowing: window minima, joined positions, matches extended both ways.

A document is a sequence of words, wherever its lines break.  The hashes of runs of RUN words are
winnowed: of every WINDOW neighbours the least is selected, with RUN + WINDOW - 1 = ``min_words``, so
two places that share ``min_words`` words share a selected hash, whatever stands around.  Selected
hashes that occur once are left out.  A hash's first place, by (id, text hash, word), is its head;
every other place is joined to the head, never to each other, so a passage in thousands of documents
costs as many rows and not pairs.  Neighbouring places on one diagonal form a chain; only the words
before and after a chain are compared, up to ``min_words`` each way, and matches that reach
``min_words`` are deleted from the later document.

All tables between the steps are written to the shared folder or shuffled; nothing of the documents
comes to the driver.  A hash with many places is one key of plain shuffle joins against one row each,
which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, slices, written
from .words import Words, mix, run_hashes, sliding, text_slices

MIN_WORDS = 50
PLACE = ["_id", "_hash"]


def split_of(min_words: int) -> tuple[int, int]:
    """(words in a hashed run, runs in a winnowing window); chosen so that neighbouring selected runs touch."""
    run = min_words // 2 + 1
    return run, min_words - run + 1


def selected(words: Words, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, word numbers in the row, and hashes of the selected runs: the minima (ties all) of the windows."""
    run, wide = split_of(min_words)
    h = run_hashes(words.hashes, run)
    least = sliding(h, wide, np.minimum)
    if not len(least):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    row = words.row_of(np.arange(len(least)))
    least[np.arange(len(least)) + min_words > words.bounds[row + 1]] = 0  # windows over a row's end
    none = np.zeros(wide - 1, np.uint64)
    at = np.flatnonzero((sliding(np.concatenate([none, least, none]), wide, np.maximum) == h) & (h != 0))
    row = words.row_of(at)
    return row, at - words.bounds[row], h[at]


def numbered(row: np.ndarray, at: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marks with their number among equal ones of the row in them, word of the previous equal one or -1)."""
    order = np.lexsort((at, mark, row))
    again = np.zeros(len(order), bool)
    again[1:] = (row[order][1:] == row[order][:-1]) & (mark[order][1:] == mark[order][:-1])
    begins = np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))
    number, prev = np.empty(len(order), np.uint64), np.full(len(order), -1, np.int64)
    number[order] = np.arange(len(order)) - begins
    prev[order[again]] = at[order[np.flatnonzero(again) - 1]]
    return np.where(number > 0, mix(mark + number * np.uint64(0xA24BAED4963EE407)), mark), prev


def marks(named: DataFrame, min_words: int) -> DataFrame:
    """_id, _hash, at, prev, mark: every selected run of every whole text.

    A text's second occurrence of a run is another mark than its first, and so on, so texts that
    repeat themselves line up occurrence by occurrence; ``prev`` is the occurrence before, or -1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 2):
            row, at, mark = selected(Words(part.column(2)), min_words)
            mark, prev = numbered(row, at, mark)
            own = pa.array(row)
            more = [pa.array(at.astype(np.int32)), pa.array(prev.astype(np.int32)), pa.array(mark.view(np.int64))]
            yield pa.RecordBatch.from_arrays([part.column(0).take(own), part.column(1).take(own), *more], names=[*PLACE, "at", "prev", "mark"])

    more = [T.StructField("at", T.IntegerType()), T.StructField("prev", T.IntegerType()), T.StructField("mark", T.LongType())]
    return lean(named.select(*PLACE, "_text")).mapInArrow(run, T.StructType([named.schema["_id"], named.schema["_hash"], *more]))


def _same(*pairs: tuple[str, str]) -> Column:
    out = F.lit(True)
    for a, b in pairs:
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def chains(named: DataFrame, min_words: int) -> DataFrame:
    """_id, _hash, first, last (words, inclusive), h_id, h_hash, h_first, h_last: chains of runs and where they stand first."""
    run, wide = split_of(min_words)
    found = written(marks(named, min_words))
    repeated = written(found.groupBy("mark").count().where("count > 1").select(F.col("mark").alias("_mark")))
    places = written(found.join(repeated, F.col("mark") == F.col("_mark"), "left").where("_mark is not null or prev >= 0"))
    head = F.min(F.struct("_id", "_hash", "at")).alias("head")
    heads = written(places.where("_mark is not null").groupBy("_mark").agg(head))
    met = places.drop("_mark").join(heads, F.col("mark") == F.col("_mark"), "left")
    # The first place of all, but the occurrence before where that is the place itself.
    elsewhere = F.col("head").isNotNull() & ~F.struct("_id", "_hash", "at").eqNullSafe(F.col("head"))
    before = F.when(F.col("prev") >= 0, F.struct("_id", "_hash", F.col("prev").alias("at")))
    later = met.select(*PLACE, "at", F.when(elsewhere, F.col("head")).otherwise(before).alias("head")).where("head is not null")
    of = Window.partitionBy(*PLACE).orderBy("at")
    flat = later.select(*PLACE, "at", F.col("head._id").alias("h_id"), F.col("head._hash").alias("h_hash"), F.col("head.at").alias("h_at"))
    past = [F.lag(c).over(of).alias(f"p_{c}") for c in ("at", "h_id", "h_hash", "h_at")]
    goes_on = _same(("h_id", "p_h_id"), ("h_hash", "p_h_hash")) & (F.col("at") - F.col("h_at") == F.col("p_at") - F.col("p_h_at")) & (F.col("at") - F.col("p_at") <= wide)
    chained = flat.select("*", *past).withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("_chain", F.sum("_new").over(of))
    ends = chained.groupBy(*PLACE, "_chain").agg(
        F.min("at").alias("first"), (F.max("at") + run - 1).alias("last"), F.first("h_id").alias("h_id"), F.first("h_hash").alias("h_hash"), F.min("h_at").alias("h_first")
    )
    return ends.select(*PLACE, "first", "last", "h_id", "h_hash", "h_first", (F.col("h_first") + F.col("last") - F.col("first")).alias("h_last"))


def _flanks(rows: DataFrame, wanted: DataFrame, text_col: str, min_words: int) -> DataFrame:
    """f_id, f_hash, f_word, f_after, flank: hashes (bytes) of up to ``min_words`` words before or after the wanted words."""
    asked = wanted.groupBy("h_id", "h_hash").agg(F.collect_set(F.struct("word", "after")).alias("_words"))
    met = rows.join(asked, _same(("_id", "h_id"), ("_hash", "h_hash"))).select("_row", *PLACE, "_words")
    schema = T.StructType(
        [T.StructField("f_id", rows.schema["_id"].dataType), T.StructField("f_hash", T.LongType()), T.StructField("f_word", T.IntegerType()),
         T.StructField("f_after", T.BooleanType()), T.StructField("flank", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            of, at, after, flank = [], [], [], []
            words = Words(b.column(0).field(text_col))
            short = words.hashes.astype(np.uint32)
            for i, asked in enumerate(b.column(3).to_pylist()):
                lo, hi = words.bounds[i], words.bounds[i + 1]
                for x in asked:
                    w = lo + x["word"]
                    of.append(i)
                    at.append(x["word"])
                    after.append(x["after"])
                    flank.append((short[w + 1 : min(hi, w + 1 + min_words)] if x["after"] else short[max(lo, w - min_words) : w]).tobytes())
            own = pa.array(of, pa.int32())
            more = [pa.array(at, pa.int32()), pa.array(after, pa.bool_()), pa.array(flank, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(1).take(own), b.column(2).take(own), *more], names=schema.names)

    return met.mapInArrow(run, schema)


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading hashes are equal."""
    n = min(len(a), len(b))
    off = np.flatnonzero(a[:n] != b[:n])
    return int(off[0]) if len(off) else n


def _line_ends(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where the line feeds are, each word's line)."""
    feeds = np.flatnonzero(data == 10)
    return feeds, np.searchsorted(feeds, starts)


def extended(hashes: np.ndarray, line_of: np.ndarray, met: list[dict], min_words: int) -> list[tuple[int, int]]:
    """The runs of a text (its words' hashes and lines) to be deleted: its chains extended both ways, where they reach ``min_words``."""
    ends: dict[tuple, list[int]] = {}
    for c in met:
        end = ends.setdefault((c["first"], c["last"], c["back"]), [c["first"], c["last"]])
        flank = np.frombuffer(c["flank"], np.uint32)
        if c["after"]:
            end[1] += _equal(hashes[c["last"] + 1 : c["last"] + 1 + min_words], flank)
        else:
            end[0] -= _equal(hashes[max(0, c["first"] - min_words) : c["first"]][::-1], flank[::-1])
    out = []
    for (_, _, back), (first, last) in ends.items():
        if last - first + 1 < min_words:
            continue
        if back is not None:  # the place before is in the same text
            kept = first - back + min_words - 1
            first = max(first, int(np.searchsorted(line_of, line_of[kept], side="right")))
        if first <= last:
            out.append((first, last))
    return out


def cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, runs: list[tuple[int, int]]) -> tuple[bytes, int]:
    """A text (its bytes, and where its words start and end) without the words of the runs, and how many lines went with them.

    A line that loses all its words goes, and so do blank lines between two lost words; of a line that
    loses some, the rest stays, with one space where words went between others.
    """
    lost = np.zeros(len(starts) + 1, np.int64)
    for first, last in runs:
        lost[first] += 1
        lost[last + 1] -= 1
    lost = np.cumsum(lost)[:-1] > 0
    feeds, line_of = _line_ends(data, starts)
    n = len(feeds) + 1
    line_lo, line_hi = np.concatenate([[0], feeds + 1]), np.concatenate([feeds, [len(data)]])
    words, gone = np.bincount(line_of, minlength=n), np.bincount(line_of[lost], minlength=n)
    after = np.searchsorted(starts, line_lo)  # for a blank line: the word after it
    between = np.zeros(n, bool)
    inner = (after > 0) & (after < len(starts))
    between[inner] = lost[after[inner] - 1] & lost[after[inner]]
    dropped = np.where(words > 0, gone == words, between)
    parts, raw = [], data.tobytes()
    plain = ~dropped & (gone == 0)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], plain, [False]]).astype(np.int8)))
    pieces = [(lo, raw[line_lo[lo] : line_hi[hi - 1]]) for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]  # whole lines
    for i in np.flatnonzero(~dropped & (gone > 0)).tolist():
        lo, hi = np.searchsorted(line_of, [i, i + 1]).tolist()
        out, parts = lost[lo:hi], []
        for k in range(hi - lo):
            if out[k]:
                continue
            a, b = int(starts[lo + k]), int(ends[lo + k])
            if k and not out[k - 1]:
                parts[-1][1] = b
            else:
                parts.append([a if k else int(line_lo[i]), b])
        if not out[-1]:
            parts[-1][1] = int(line_hi[i])
        pieces.append((i, b" ".join(raw[a:b] for a, b in parts)))
    return b"\n".join(x for _, x in sorted(pieces)), int(dropped.sum())


def cut_text(text: str, runs: list[tuple[int, int]]) -> tuple[str, int]:
    """``cut`` for one text."""
    words = Words(pa.array([text], pa.large_string()))
    out, gone = cut(words.data[: words.row_at[-1]], words.starts, words.ends, runs)
    return out.decode(), gone


def dedup_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, removed_col: str | None = None
) -> DataFrame:
    """``df`` with later repeats of passages of at least ``min_words`` words deleted from ``text_col``.

    A passage is a run of words, wherever lines break; a later place of one, by (id, text hash, word),
    loses its words if its match with the first place of one of the passage's selected hashes has
    ``min_words`` words.  A later place in the same text loses only words on lines after the ones that
    hold the first ``min_words`` words of the place before, so no line is cut by itself.  Lines that lose all their
    words go, all other lines (blank ones between runs too) stay.  Texts without a repeat come back
    unchanged, null and empty ones too, and one output row per input row.  Equal texts under different
    ids are repeats: all but the least id lose their words; rows of one id and one text count as one
    document.  Null ids sort first.  ``removed_col`` adds the number of lines deleted, in place of a
    column of that name; columns of any other name pass through.
    """
    rows = df.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"))
    named = df.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_text")).where(F.col(text_col).isNotNull())
    found = written(chains(named, min_words))
    back = F.when(_same(("_id", "h_id"), ("_hash", "h_hash")), F.col("first") - F.col("h_first")).alias("back")
    end = F.explode(F.array(F.struct(F.col("h_first").alias("word"), F.lit(False).alias("after")), F.struct(F.col("h_last").alias("word"), F.lit(True).alias("after"))))
    ends = found.select(F.col("_id").alias("m_id"), F.col("_hash").alias("m_hash"), "h_id", "h_hash", "first", "last", back, end.alias("_end")).select("*", "_end.*")
    flanks = _flanks(rows, ends.select("h_id", "h_hash", "word", "after").distinct(), text_col, min_words)
    sided = ends.join(flanks, _same(("h_id", "f_id"), ("h_hash", "f_hash"), ("word", "f_word"), ("after", "f_after")))
    met = sided.groupBy("m_id", "m_hash").agg(F.collect_list(F.struct("first", "last", "back", "after", "flank")).alias("_met"))
    joined = rows.join(met, _same(("_id", "m_id"), ("_hash", "m_hash")), "left").select("_row", "_met")

    @F.arrow_udf("struct<text:string,gone:bigint>")
    def done(texts: pa.Array, chains: pa.Array) -> pa.Array:
        out, lines = [None] * len(texts), np.zeros(len(texts), np.int64)
        touched = np.flatnonzero(chains.is_valid().to_numpy(zero_copy_only=False))
        for lo in range(0, len(touched), 256):
            at = touched[lo : lo + 256]
            own = texts.take(pa.array(at))
            words = Words(own)
            short = words.hashes.astype(np.uint32)
            for k, i in enumerate(at.tolist()):
                a, z, base = words.bounds[k], words.bounds[k + 1], words.row_at[k]
                data, starts, ends = words.data[base : words.row_at[k + 1]], words.starts[a:z] - base, words.ends[a:z] - base
                runs = extended(short[a:z], _line_ends(data, starts)[1], chains[i].as_py(), min_words)
                out[i], lines[i] = cut(data, starts, ends, runs) if runs else (data.tobytes(), 0)
        return pa.StructArray.from_arrays([pa.array(out, pa.binary()).cast(pa.string()), pa.array(lines)], names=["text", "gone"])

    cleaned = joined.select("_row", "_met", done(F.when(F.col("_met").isNotNull(), F.col("_row")[text_col]), "_met").alias("_done"))
    own = F.when(F.col("_met").isNull(), F.col("_row")[text_col]).otherwise(F.col("_done.text"))
    keep = [c for c in df.columns if removed_col is None or c.lower() != removed_col.lower()]
    cols = [(own if c == text_col else F.col("_row")[c]).alias(c) for c in keep]
    return cleaned.select(*cols, *([F.coalesce("_done.gone", F.lit(0)).cast("long").alias(removed_col)] if removed_col else []))
