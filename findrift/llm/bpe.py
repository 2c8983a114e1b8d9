"""Byte-level BPE through a distinct-word table.

Spark splits the texts into words (the vocabulary's own pre-tokenising pattern, in the JVM).  The
distinct words of the whole corpus, with their numbers, are one table; its most frequent words, a bounded
number (TABLE_WORDS), are encoded once, and their ids go to every task, which joins them back by position.
By Zipf's law these are nearly all places.  Words outside the bound are encoded where they stand, once a
slice of rows: joining the tail back by position as well would shuffle a row for each of its places, far
more than the texts themselves.  Decoding joins ids with the id-to-piece table, which the vocabulary
bounds and every task holds: an id is the piece's row, so that join is a gather.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, slices, written

#: (?U): white space as Unicode defines it, as the tokenizer's engine does.
WORDS = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words whose ids go to every task: the most frequent ones of at most so many characters.
TABLE_WORDS, TABLE_CHARS = 100_000, 32
#: Characters that the JVM's Unicode tables don't know may be letters in newer ones.
UNKNOWN = r"\p{Cn}|\p{Co}"


def split_words(text: Column, specials: Sequence[str] = ()) -> Column:
    """A text's words as array<string>, special tokens whole; they concatenate to the text.

    Null where a character is unassigned in the JVM's Unicode tables: such a text is encoded whole.
    """
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    if specials:
        import re

        special = "|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True))
        marks = F.regexp_extract_all(text, F.lit(special), F.lit(0))
        mixed = F.flatten(
            F.transform(
                F.split(text, special, -1),
                lambda s, i: F.concat(
                    F.when(i > 0, F.array(F.get(marks, i - 1))).otherwise(F.array().cast("array<string>")),
                    F.regexp_extract_all(s, F.lit(WORDS), F.lit(0)),
                ),
            )
        )
        words = F.when(text.rlike(special), mixed).otherwise(words)
    return F.when(~text.rlike(UNKNOWN), words)


def load(path: str) -> str:
    """The definition of a byte-level BPE tokenizer; other kinds are refused."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    spec = json.loads(text)
    pre = spec.get("pre_tokenizer") or {}
    if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
        raise ValueError("only plain byte-level BPE vocabularies are supported")
    return text


def specials_of(spec: str) -> list[str]:
    return [t["content"] for t in json.loads(spec)["added_tokens"]]


def pieces(spec: str) -> pa.LargeBinaryArray:
    """The id-to-piece table: the bytes of every id; empty for ids without a piece."""
    s = json.loads(spec)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    vocab = s["model"]["vocab"]
    top = max([*vocab.values(), *(t["id"] for t in s["added_tokens"])]) + 1
    table: list[bytes] = [b""] * top
    for piece, i in vocab.items():
        table[i] = bytes(to_byte[c] for c in piece)
    for t in s["added_tokens"]:
        table[t["id"]] = t["content"].encode()
    return pa.array(table, pa.large_binary())


class WordEncoder:
    """Encodes distinct words; whole texts only where the JVM could not split them."""

    def __init__(self, spec: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers.pre_tokenizers import ByteLevel

        self.spec, self.whole = spec, None
        self.word = self._made()
        self.word.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)

    def _made(self):
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(self.spec)
        t.no_truncation()
        t.no_padding()
        return t

    def words(self, words: list[str], step: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, where each word's ids start; one more at the end)."""
        ids, counts = [], []
        for lo in range(0, len(words), step):
            for e in self.word.encode_batch_fast(words[lo : lo + step], add_special_tokens=False):
                own = e.ids
                ids += own
                counts.append(len(own))
        return np.array(ids, np.int32), np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])

    def text(self, text: str) -> list[int]:
        self.whole = self.whole or self._made()
        return self.whole.encode(text, add_special_tokens=False).ids


def word_counts(words: DataFrame) -> DataFrame:
    """word, n: every distinct word in the arrays of ``_words``, and its number; counted in batches first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pc.value_counts(b.column(0).flatten())
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"])

    return lean(words.select("_words")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, spec: str, most: int) -> pa.Table:
    """word and ids of the most frequent words of ``word_counts``, ``most`` at most, each encoded once.

    Words of equal frequency, to an eighth of a power of two, are in or out together; longer words than
    TABLE_CHARS are out, so that the table's size is bounded.
    """
    short = written(counts.where(F.length("word") <= TABLE_CHARS))
    size = F.floor(F.log2("n") * 8).cast("int")
    sizes = short.groupBy(size.alias("size")).count().collect()  # 8 * 63 rows at most
    least, held = None, 0
    for r in sorted(sizes, key=lambda r: -r["size"]):
        if held + r["count"] > most:
            break
        least, held = r["size"], held + r["count"]
    chosen = short.where(size >= least) if held else short.limit(0)
    shared = counts.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = WordEncoder(shared.value)
        for b in batches:
            ids, starts = enc.words(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids))], names=["word", "ids"])

    return chosen.select("word").mapInArrow(run, "word string, ids array<int>").toArrow()


class _Table:
    """The frequent words' ids, held by a task."""

    def __init__(self, packed: bytes) -> None:
        t = pa.ipc.open_stream(packed).read_all()
        self.row, ids, sizes = {}, [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for b in t.to_batches():
            self.row.update(zip(b.column(0).to_pylist(), range(len(self.row), len(self.row) + b.num_rows), strict=True))
            ids.append(b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int32))
            sizes.append(pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
        self.ids, self.starts = np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def _gather(ids: np.ndarray, starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words ``at``, in order, and the running count before each word."""
    counts = np.diff(starts)[at]
    ends = np.concatenate([[0], np.cumsum(counts)])
    index = np.repeat((starts[:-1][at] - ends[:-1]).astype(np.int32), counts)
    index += np.arange(ends[-1], dtype=np.int32)
    return ids[index], ends


def _encode_slice(enc: WordEncoder, table: _Table, words: pa.ListArray, texts: pa.StringArray) -> pa.ListArray:
    """The ids of each row of a slice: its distinct words looked up in the table, the others encoded."""
    coded = pc.dictionary_encode(words.flatten())
    distinct = coded.dictionary.to_pylist()
    found = np.array([table.row.get(w, -1) for w in distinct], np.int64)
    lacking = np.flatnonzero(found < 0)
    own, own_starts = enc.words([distinct[i] for i in lacking.tolist()])
    known = found[found >= 0]
    known_ids, known_ends = _gather(table.ids, table.starts, known)
    # One small table of the slice's words: the known ones first, then the encoded ones.
    ids, starts = np.concatenate([known_ids, own]), np.concatenate([known_ends, known_ends[-1] + own_starts[1:]])
    place = np.empty(len(distinct), np.int64)
    place[found >= 0], place[lacking] = np.arange(len(known)), np.arange(len(known), len(distinct))
    index = place[coded.indices.to_numpy(zero_copy_only=False)] if len(distinct) else np.empty(0, np.int64)
    out, ends = _gather(ids, starts, index)
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = ends[np.concatenate([[0], np.cumsum(sizes)])]
    whole = words.is_null().to_numpy(zero_copy_only=False)
    if whole.any():
        # Texts that the JVM could not split: rare, encoded whole and put in place.
        parts = np.split(out, offsets[1:-1])
        for i in np.flatnonzero(whole).tolist():
            parts[i] = np.array(enc.text(texts[i].as_py() or ""), np.int32)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in parts])])
        out = np.concatenate(parts)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out, pa.int32()))


def encode(
    df: DataFrame, path: str, keep: Sequence[str] = ("doc_id",), text_col: str = "text", ids_col: str = "ids", digests: bool = False, with_ids: bool = True,
    table_words: int = TABLE_WORDS,
) -> DataFrame:
    """Token ids of every whole text: the columns ``keep`` and ``ids_col`` (array<int>).

    Special tokens' strings become their ids; none is added, and nothing is cut or padded.  A null or
    empty text has no ids; one output row per input row, repeated rows included; columns outside
    ``keep`` are ignored, and a kept column with the name of an output gives way to it.  ``digests`` adds
    what ``digest`` adds, made by the same worker; ``with_ids`` false leaves the ids themselves out.
    ``table_words`` bounds the words whose ids every task holds; the result is the same for any.
    """
    outputs = [T.StructField(ids_col, T.ArrayType(T.IntegerType()))] * with_ids + DIGESTS * digests
    taken = {f.name.lower() for f in outputs}
    keep = [c for c in dict.fromkeys(keep) if c.lower() not in taken]
    spec, n = load(path), len(keep)
    sc = df.sparkSession.sparkContext
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    inner = df.select(*kept, split_words(text, specials_of(spec)).alias("_words"), F.when(text.rlike(UNKNOWN), text).alias("_text"))
    frequent = frequent_words(word_counts(inner), spec, table_words)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, frequent.schema) as writer:
        writer.write_table(frequent)
    shared, held = sc.broadcast(spec), sc.broadcast(sink.getvalue().to_pybytes())
    schema = T.StructType([*[T.StructField(f"_k{i}", df.schema[c].dataType) for i, c in enumerate(keep)], *outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, words = WordEncoder(shared.value), _Table(held.value)
        shown = _Digests(shared.value) if digests else None
        for b in slices(batches, 512):
            ids = _encode_slice(enc, words, b.column(n), b.column(n + 1))
            more = [ids] * with_ids + (shown.of(ids) if shown else [])
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *more], names=schema.names)

    done = lean(inner).mapInArrow(run, schema)
    return done.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f.name) for f in outputs])


def _per_row(ids: pa.ListArray, table: pa.LargeBinaryArray) -> list[memoryview]:
    """The concatenated entries of ``table`` for each row's ids."""
    flat = ids.flatten()
    taken = table.take(flat)
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    if not len(taken):
        return [memoryview(b"")] * len(ids)
    bounds = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1][at]
    data = memoryview(taken.buffers()[2])
    return [data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


DIGESTS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


class _Digests:
    """Digests of ids and of the texts that they decode to, by gathers from two tables that the vocabulary bounds."""

    def __init__(self, spec: str) -> None:
        self.table = pieces(spec)
        self.decimal = pa.array([b"%d," % i for i in range(len(self.table))], pa.large_binary())

    def of(self, ids: pa.ListArray) -> list[pa.Array]:
        counts = pc.fill_null(pc.list_value_length(ids), 0).cast(pa.int64())
        shown = [hashlib.sha256(x[:-1] if len(x) else x).hexdigest() for x in _per_row(ids, self.decimal)]
        texts = [hashlib.sha256(str(x, "utf-8", "replace").encode()).hexdigest() for x in _per_row(ids, self.table)]
        return [counts, pa.array(shown, pa.string()), pa.array(texts, pa.string())]


def decode(df: DataFrame, path: str, keep: Sequence[str] = ("doc_id",), ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """Texts of token ids, special tokens included; bytes that are no UTF-8 become U+FFFD.

    Null ids give an empty text.  Ids outside the vocabulary raise an error.
    """
    shared = df.sparkSession.sparkContext.broadcast(load(path))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(shared.value)
        for b in slices(batches, 1024):
            texts = pa.array([bytes(x).decode("utf-8", "replace") for x in _per_row(b.column(n), table)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:n], texts], names=[*keep, text_col])

    schema = T.StructType([*[T.StructField(c, df.schema[c].dataType) for c in keep], T.StructField(text_col, T.StringType())])
    return df.select(*keep, ids_col).mapInArrow(run, schema)


def digest(df: DataFrame, path: str, keep: Sequence[str] = ("doc_id",), ids_col: str = "ids") -> DataFrame:
    """``keep``, n_tokens, ids_sha256 and, decoded through the id-to-piece table, decoded_sha256."""
    shared = df.sparkSession.sparkContext.broadcast(load(path))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown = _Digests(shared.value)
        for b in slices(batches, 1024):
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *shown.of(b.column(n))], names=[*keep, *[f.name for f in DIGESTS]])

    schema = T.StructType([*[T.StructField(c, df.schema[c].dataType) for c in keep], *DIGESTS])
    return df.select(*keep, ids_col).mapInArrow(run, schema)
