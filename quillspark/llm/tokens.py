"""Token-ID output: Parquet list columns with controlled encodings, row groups and page indexes."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.batches import sliced, texts, tidied
from quillspark.llm.shared import new_path, partitions, shuffles_freed, small_batches, written
from quillspark.sources.tables import table

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
#: Encoded words that a Python worker keeps in each of two generations.
CACHED_CHUNKS = 100_000
#: Batches that workers get, and texts that are encoded at once (a longer one alone): an executor holds what encoding them
#: takes once for each core, beside all that its JVM took in earlier stages.
BATCH_ROWS, BATCH_BYTES, TEXT_BYTES = 2500, 4 << 20, 6 << 20
STOPS = ".,!?;:"
#: Texts that tell whether a vocabulary's ids are those of a text's pieces.
PROBES = ("a b", "Two words, and more.  So\nit goes; on: here! x_y 12", " É è  Straße\n\nco-op don't AbC")
#: Letters that are one character in any normal form and have one lower-case letter.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Writer settings: ids get a dictionary (they repeat), positions get delta encoding (they ascend), page indexes are
#: always written, and groups and pages are small enough to read a few documents without their neighbours.
WRITER = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#tokens.list.element": "true",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
}
SCHEMA = "doc_id long, part int, part_start long, n_tokens long, tokens array<int>"


class ChunkEncoder:
    """Encodes texts through a tokenizers file, each distinct piece between blanks once.

    That is right where pre-tokenizers drop white space and neither they nor the normalizers look across it: then the ids
    of a text are those of its pieces between spaces and line feeds in a row. Stops right after a letter begin
    another pre-token in any case and are taken apart; pieces of plain letters alone are looked up in lower case. A
    vocabulary whose ids of some probes differ that way gets whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.last[[k for token, k in vocabulary.items() if token.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.apart = bool(suffix) and all(self._same_apart(text) for text in PROBES)

    def _same_apart(self, text: str) -> bool:
        whole = self.tokenizer.encode(text, add_special_tokens=False).ids
        return self._encode_apart(pa.array([text]), 0)[0].to_pylist() == [*whole, 0]

    def _fresh(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of pieces. Those of letters alone go many to a call, and the ids that end a word tell them apart; were
        one of them more than one pre-token, the ends would be too many, and each goes alone."""
        encode, out = self.tokenizer.encode_batch_fast, {}
        alone = [c for c in chunks if not c.isalpha()]
        words = [c for c in chunks if c.isalpha()]
        groups = [words[at : at + 256] for at in range(0, len(words), 256)]
        # What the library returns has much more than ids, so few are asked for at a time.
        several = (groups[at : at + 8] for at in range(0, len(groups), 8))
        answers = (zip(some, encode([" ".join(g) for g in some], add_special_tokens=False), strict=True) for some in several)
        for group, found in chain.from_iterable(answers):
            ids = np.array(found.ids, np.int32)
            ends = (np.flatnonzero(self.last[ids]) + 1) * 4
            if len(ends) != len(group):
                alone += group
                continue
            data, at = ids.tobytes(), 0
            for word, end in zip(group, ends.tolist(), strict=True):
                out[word] = data[at:end]
                at = end
        for at in range(0, len(alone), 2000):
            some = alone[at : at + 2000]
            for chunk, found in zip(some, encode(some, add_special_tokens=False), strict=True):
                out[chunk] = array("i", found.ids).tobytes()
        return out

    def _encoded(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct pieces; words are remembered."""
        if len(self.known) > CACHED_CHUNKS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        missing = [c for c in chunks if c not in known]
        if older:
            known.update((c, older[c]) for c in missing if c in older)
            missing = [c for c in missing if c not in known]
        known.update(self._fresh(missing))
        out = [known[c] for c in chunks]
        for c in missing:
            if not c.isalpha():
                del known[c]
        return out

    def forget(self) -> None:
        """Drops all pieces: an idle worker's memory counts beside that of the next stage."""
        self.known, self.older = {}, {}
        tidied()

    def encode(self, column: pa.Array, end_id: int) -> tuple[pa.Array, np.ndarray]:
        """The ids of all texts in a row, each text's followed by the end id; and how many each text has."""
        if self.apart:
            return self._encode_apart(column, end_id)
        found = [[*e.ids, end_id] for e in self.tokenizer.encode_batch_fast(column.to_pylist(), add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return pa.array(np.fromiter((k for ids in found for k in ids), np.int32, int(lengths.sum()))), lengths

    def _encode_apart(self, column: pa.Array, end_id: int) -> tuple[pa.Array, np.ndarray]:
        apart = pc.replace_substring_regex(pc.replace_substring(column, "\n", " "), f"([{LETTERS}])([{STOPS}])", r"\1 \2")
        pieces = pc.split_pattern(apart, " ")
        del apart  # what is done with goes at once: all of it together would be several times the texts
        ends = np.asarray(pieces.offsets, dtype=np.int64)[1:] - pieces.offsets[0].as_py()
        coded = pieces.flatten().dictionary_encode()
        del pieces
        cased = coded.dictionary
        simple = pc.match_substring_regex(cased, f"^[{LETTERS}]+$")
        plain = pc.if_else(simple, pc.utf8_lower(cased), cased).dictionary_encode()
        which = np.asarray(plain.indices)[np.asarray(coded.indices)]
        del coded, cased, simple
        ids = self._encoded(plain.dictionary.to_pylist())
        del plain
        ids.append(array("i", [end_id]).tobytes())
        lengths = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(ids), np.int32)))
        codes = np.insert(which, ends, len(ids) - 1)
        del which
        counts = np.diff(np.cumsum(lengths[codes], dtype=np.int64)[ends + np.arange(len(ends))], prepend=0)
        return lists.take(pa.array(codes)).flatten(), counts


_ENCODERS: dict[str, ChunkEncoder] = {}


def _encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID) -> None:
    """Writes the ids of all texts as a token table, in ascending doc_id order over its files.

    docs has doc_id and text; other columns are ignored. Null and empty texts have the end id alone; a null doc_id
    sorts first; rows of one doc_id are ordered by text and each is written. An empty table gives an empty token
    table. A row holds the number of its file part and where it starts in that part, so a global position needs only
    the parts' totals, which are written beside the tokens.
    """
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, part, at = _encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in sliced(batches, limit=TEXT_BYTES):
            ids, counts = encoder.encode(texts(batch), end_id)
            ends = np.cumsum(counts)
            columns = [
                batch.column("doc_id"),
                pa.array(np.full(len(counts), part, np.int32)),
                pa.array(at + ends - counts),
                pa.array(counts),
                pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), ids),
            ]
            at += int(ends[-1])
            out = pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "part_start", "n_tokens", "tokens"])
            del batch, ids, counts, ends, columns  # else they would stay beside the next batch
            yield out
            del out
        encoder.forget()

    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(partitions(docs), "doc_id")
    encoded = ranged.sortWithinPartitions("doc_id", "text").mapInArrow(encode, SCHEMA)
    with small_batches(spark, BATCH_ROWS, BATCH_BYTES), shuffles_freed(spark):
        encoded.write.options(**WRITER).parquet(f"{path}/tokens")
    totals = spark.read.parquet(f"{path}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    totals.write.parquet(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The token table, or the documents from ``first`` to ``last``: the bounds prune row groups and pages."""
    rows = spark.read.schema(SCHEMA).parquet(f"{path}/tokens")
    if first is not None:
        rows = rows.filter(F.col("doc_id") >= first)
    return rows if last is None else rows.filter(F.col("doc_id") <= last)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, part_start, n_tokens: no page of the ids is read."""
    return read_tokens(spark, path).drop("tokens")


def part_starts(spark: SparkSession, path: str) -> dict[int, int]:
    """The ids before each part: one number for each file."""
    starts, at = {}, 0
    for part, n in sorted(tuple(r) for r in spark.read.parquet(f"{path}/parts").collect()):
        starts[part], at = at, at + n
    return starts


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from its ids in the files. They are written at once, as ids go to
    Python in small batches only while a table is written."""
    starts = part_starts(spark, path)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            offsets = np.asarray(lists.offsets, dtype=np.int64)
            values = memoryview(np.ascontiguousarray(np.asarray(lists.values), dtype="<u4")).cast("B")
            sums = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            base = np.array([starts[p] for p in batch.column("part").to_pylist()], np.int64)
            start = base + np.asarray(batch.column("part_start"))
            columns = [batch.column("doc_id"), pa.array(start), pa.array(np.diff(offsets)), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path).select("doc_id", "part", "part_start", "tokens")
    with small_batches(spark, BATCH_ROWS, BATCH_BYTES):
        return written(rows.mapInArrow(check, "doc_id long, start long, n_tokens long, ids_crc32 long"), "token-sums")[0]


def public_vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_output(spark, sf_dir):
    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_vocabulary())
    return checksums(spark, path)


QUERIES = {"op1_token_output": op1_token_output}
ORACLE: dict[str, str] = {}
