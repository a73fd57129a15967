"""Packing documents into training sequences: shortest pack first over the histogram of lengths."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlemill.llm.common import running, texts
from candlemill.session import stage

SIZE = 2048
END_ID = 1
CHUNK_ROWS = 256

# ---- tokens -------------------------------------------------------------------------------------

# Characters at which Python and the tokenizers disagree about white space.
ODD_SPACES = "\x1c\x1d\x1e\x1f\x85\u180e"
# In texts of these alone (in Latin-1), a full stop or comma is a token of its own unless it is next to another.
_LETTERS = [*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]
PLAIN = bytes([*b"0123456789 \t\n\x0b\x0c\r.,", *_LETTERS])
TWO_MARKS = ("..", ",,", ".,", ",.")
KNOWN_WORDS = 1_000_000
BATCH_CHARS = 4_000_000


class WordEncoder:
    """``Tokenizer.encode`` through a memory of words, for a vocabulary whose words never cross white space.

    The ids of a text are those of its words one after the other, so each new word goes through the tokenizer
    once; ids are kept as little-endian 4-byte strings. Plain texts are lower-cased and their stops and commas
    set apart first, as the tokenizer does, so that a word is known however it is written. Texts with characters
    that Python takes for spaces and the tokenizer does not, or the other way round, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def words(text: str) -> list[str]:
        try:
            plain = not text.encode("latin-1").translate(None, PLAIN) and not any(m in text for m in TWO_MARKS)
        except UnicodeEncodeError:
            plain = False
        return (text.lower().replace(".", " . ").replace(",", " , ") if plain else text).split()

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Words of letters alone are one token run each, whose last id ends a word, so they go in lines of many."""
        fresh, one_by_one = {}, [w for w in new if not w.isalpha()]
        letters = [w for w in new if w.isalpha()]
        lines = [letters[i:i + 200] for i in range(0, len(letters), 200)]
        for words, found in zip(lines, self.tokenizer.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(ends) != len(words):
                one_by_one += words
                continue
            raw = ids.tobytes()
            fresh.update((w, raw[4 * a:4 * b]) for w, a, b in zip(words, [0, *ends], ends))
        for at in range(0, len(one_by_one), 4000):
            some = one_by_one[at:at + 4000]
            for word, found in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                fresh[word] = np.array(found.ids, "<u4").tobytes()
        return fresh

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. All words that are new in these texts are learned in one go."""
        out: list[bytes] = [b""] * len(texts)
        waiting, new, get = [], set(), self.known.get
        for i, text in enumerate(texts):
            if any(c in text for c in ODD_SPACES):
                out[i] = self.whole(text)
                continue
            words = self.words(text)
            parts = list(map(get, words))
            try:
                out[i] = b"".join(parts)
            except TypeError:  # None among them
                waiting.append((i, words, parts))
                new.update(w for w, p in zip(words, parts) if p is None)
        fresh = self._learn(list(new))
        for i, words, parts in waiting:
            out[i] = b"".join([fresh[w] if p is None else p for w, p in zip(words, parts)])
        if len(self.known) + len(fresh) > KNOWN_WORDS:  # the words met first are the common ones
            self.known = dict(islice(self.known.items(), KNOWN_WORDS // 2))
        self.known.update(islice(fresh.items(), KNOWN_WORDS // 2))
        return out


def in_parts(texts: list[bytes]) -> Iterator[list[str]]:
    """Consecutive texts, so many at a time that their words take little memory."""
    part, size = [], 0
    for text in texts:
        part.append(text.decode("utf-8", "replace"))
        size += len(text)
        if size > BATCH_CHARS:
            yield part
            part, size = [], 0
    yield part


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per worker process and path; it is kept from task to task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, and ids (array of int) if asked for: documents cut every ``size`` ids.

    A document is its ids and then ``end_id``; a null or empty text is that id alone. ``path`` names a tokenizer
    file that every worker has.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long"
    end, step = np.array([end_id], "<u4").tobytes(), 4 * size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_all
        for batch in batches:
            rows, starts, lengths, sums, totals, ids = [], [], [], [], [], []
            for i, found in enumerate(x for part in in_parts(texts(batch)) for x in encode(part)):
                tokens = found + end
                for at in range(0, len(tokens), step):
                    piece = tokens[at:at + step]
                    rows.append(i)
                    starts.append(at // 4)
                    lengths.append(len(piece) // 4)
                    sums.append(zlib.crc32(piece))
                    totals.append(len(tokens) // 4)
                    if with_ids:
                        ids.append(np.frombuffer(piece, "<u4").astype(np.int32))
            out = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                out.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    return docs.select("doc_id", "text").mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


# ---- packs --------------------------------------------------------------------------------------

def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Place all pieces, longest first, each into the open pack that has the most room; open one if none has enough.

    Works on counts, never on single pieces: packs with consecutive numbers and equal contents are one pattern,
    and a step puts one piece of a length into each of the packs of a pattern (or into the first of them, which
    splits it). Steps: (length, rank of the first piece among those of its length, pieces, first pack, offset).
    Their number depends on the lengths there are, not on how many pieces there are.
    """
    steps, packs = [], 0
    patterns: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # by room: (first pack, packs)
    top = 0
    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        rank, left, top = 0, histogram[length], size
        while left:
            while top >= length and not patterns[top]:
                top -= 1
            if top < length:  # as many packs as the rest needs, each open to the next piece of this length
                fresh = -(-left // (size // length))
                patterns[size].append((packs, fresh))
                packs += fresh
                top = size
            first, count = patterns[top].pop()
            used = min(count, left)
            if used < count:
                patterns[top].append((first + used, count - used))
            steps.append((length, rank, used, first, size - top))
            patterns[top - length].append((first, used))
            rank, left = rank + used, left - used
    return steps


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` (doc_id, start, length and more) with sequence_id and offset, gapless from 0 in each sequence.

    The histogram has at most ``size`` rows, and so the driver makes the patterns. Pieces of a length are then
    numbered (in chunks, see ``running``) and find their step by number. ``pieces`` is read three times.
    """
    histogram = pieces.groupBy("length").agg(F.count("*").alias("count"))
    counts = {r["length"]: r["count"] for r in histogram.collect()}
    steps = np.array(sorted(shortest_pack_first(counts, size)), np.int64).reshape(-1, 5)
    shift = np.int64(1 << 40)
    keys, (_, ranks, _, packs, offsets) = steps[:, 0] * shift + steps[:, 1], steps.T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            length, rank = (at[n].to_numpy(zero_copy_only=False) for n in ("length", "_rank"))
            step = np.searchsorted(keys, length * shift + rank, side="right") - 1
            at["sequence_id"] = pa.array(packs[step] + rank - ranks[step])
            at["offset"] = pa.array(offsets[step])
            names = [n for n in at if n != "_rank"]
            yield pa.RecordBatch.from_arrays([at[n] for n in names], names)

    spread = F.xxhash64("doc_id", "start")
    chunk = F.floor(F.shiftrightunsigned(spread, 32) * F.ceil(F.col("_count") / CHUNK_ROWS) / F.lit(1 << 32)).cast("long")
    bounded = F.broadcast(histogram.withColumnRenamed("count", "_count"))  # one row per length
    dealt = pieces.join(bounded, "length").withColumn("_chunk", chunk).drop("_count")
    ranked = running(dealt, ["length"], "_chunk", [spread, "doc_id", "start", *(c for c in ("ids_crc32",) if c in pieces.columns)], F.lit(1), "_rank")
    ranked = ranked.select(*pieces.columns, F.col("_rank").cast("long").alias("_rank"))
    from pyspark.sql.types import LongType, StructType

    schema = StructType(list(pieces.schema.fields)).add("sequence_id", LongType()).add("offset", LongType())
    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every document lies in exactly one piece. Other columns are not read; a row that is there twice is packed twice. An empty table gives an empty result.
    """
    return pack(stage(token_pieces(docs, path, size, end_id), "pieces"), size)


def sequences(docs: DataFrame, packed: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids): the padded sequences that ``packed`` plans for ``docs``, whose ids must be unique.

    The pieces are encoded again rather than carried along, and each group is one sequence, so it is bounded.
    """
    ids = token_pieces(docs, path, size, end_id, with_ids=True).select("doc_id", "start", "ids")
    placed = packed.select("doc_id", "start", "sequence_id", "offset").join(ids, ["doc_id", "start"])
    rows = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    flat = F.flatten(F.transform("p", lambda x: x["ids"]))
    return rows.select("sequence_id", F.concat(flat, F.array_repeat(F.lit(pad_id), size - F.size(flat))).alias("ids"))
