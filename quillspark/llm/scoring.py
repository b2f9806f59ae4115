"""LM scoring by online logistic context mixing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from math import ceil, log2, log10, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.batches import sliced, texts
from quillspark.llm.compression import drawn, fold
from quillspark.llm.mixer import CELLS, ORDERS, SLOT_BITS, Code, Counts, Mixer, Spelling, Table, gathered, mixed
from quillspark.llm.shared import driver_tidied, removed, written
from quillspark.sources.tables import table

#: Words that have a symbol of their own: the most frequent ones.
SYMBOLS = 1 << 15
#: Parts of the training documents: weights are fitted to each part under the context tables of the other.
PARTS = 2
#: Numbers for each piece of a vector that tasks sum up.
PIECE = 1 << 17
#: Word counts, and numbers of contexts, that a task holds before it hands them on.
HELD_WORDS, HELD_NUMBERS = 800_000, 2_500_000
#: Tokens for each page of context counts.
PAGE_TOKENS = 1_000_000
ADDED = 0.1


def split_words(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """All texts' words between ASCII white space, A-Z lower-cased: their numbers among the distinct words, those, and
    how many words each text has."""
    pieces = pc.ascii_split_whitespace(pc.ascii_lower(column))
    offsets = np.asarray(pieces.offsets, dtype=np.int64)
    coded = pieces.flatten().dictionary_encode()
    codes, empty = np.asarray(coded.indices), pc.index(coded.dictionary, "").as_py()
    kept = codes != empty
    upto = np.concatenate([[0], np.cumsum(kept)])[offsets - offsets[0]]
    return codes[kept], coded.dictionary, np.diff(upto)


def word_keys(words: pa.Array) -> np.ndarray:
    """A 64-bit number for each word, which stands for it in joins and contexts: the sum of its bytes under weights by
    place, mixed; 0 for the empty word."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    lengths = np.diff(offsets)
    out, filled = np.zeros(len(words), np.uint64), lengths > 0
    if filled.any():
        data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
        lengths, starts = lengths[filled], (offsets[:-1] - offsets[0])[filled]
        weights = mixed(np.arange(1, int(lengths.max()) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        place = np.arange(len(data)) - np.repeat(starts, lengths)
        out[filled] = mixed(np.add.reduceat((data + np.uint64(1)) * weights.take(place), starts))
    return out


def counted(docs: DataFrame) -> DataFrame:
    """(word, c): all distinct words of docs (text, learns) and how often they stand in the rows that learn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def handed() -> pa.Table:
            summed = pa.concat_tables(held).group_by("word").aggregate([("c", "sum")])
            return summed.select(["word", "c_sum"]).rename_columns(["word", "c"]).combine_chunks()

        for batch in sliced(batches):
            codes, words, each = split_words(texts(batch))
            learns = np.repeat(np.asarray(batch.column("learns").to_numpy(zero_copy_only=False), dtype=float), each)
            found = np.bincount(codes, weights=learns, minlength=len(words)).astype(np.int64)
            rows = pa.table({"word": words, "c": pa.array(found)})
            held.append(rows.filter(pc.not_equal(rows["word"], "")))
            if sum(t.num_rows for t in held) > HELD_WORDS:
                yield from handed().to_batches()
                held.clear()
        if held:
            yield from handed().to_batches()

    partial = docs.select("text", "learns").mapInArrow(run, "word string, c long")
    return partial.groupBy("word").agg(F.sum("c").alias("c"))


def frequent_words(words: DataFrame) -> list:
    """The most frequent words, SYMBOLS at most, by count. Counts are put into bins of 1/16 of a power of two, and within the
    bin that doesn't fit are told apart one by one; of the words of the count that doesn't fit those with the least hashes
    are taken. So no more than about these reach the driver, however many tasks there are."""
    binned = words.filter("c > 0").select("word", "c", F.floor(F.log2(F.col("c").cast("double")) * 16).cast("int").alias("bin"))
    taken, least, next_bin = 0, None, None
    for bin_, n in sorted((tuple(r) for r in binned.groupBy("bin").count().collect()), reverse=True):
        if taken + n > SYMBOLS:
            next_bin = bin_
            break
        taken, least = taken + n, bin_
    rows = binned.filter(F.col("bin") >= least).select("word", "c").collect() if least is not None else []
    if next_bin is not None and taken < SYMBOLS:
        binned, above = binned.filter(F.col("bin") == next_bin), None
        for c, n in sorted((tuple(r) for r in binned.groupBy("c").count().collect()), reverse=True):
            if taken + n > SYMBOLS:
                break
            taken, above = taken + n, c
        rows += binned.filter(F.col("c") >= above).select("word", "c").collect() if above is not None else []
        rows += drawn(binned.filter(F.col("c") == c), "bin", F.col("word"), SYMBOLS - taken).select("word", "c").collect() if taken < SYMBOLS else []
    return sorted(rows, key=lambda r: (-r.c, r.word))


@dataclass
class Vocabulary:
    """Words with symbols of their own; the next symbol stands for any other word, the last for the end."""

    numbers: dict[str, int]

    @cached_property
    def listed(self) -> pa.Array:
        return pa.array(list(self.numbers), pa.string())

    @property
    def rare(self) -> int:
        return len(self.numbers)

    @property
    def end(self) -> int:
        return len(self.numbers) + 1

    def laid(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All texts' tokens in a row, ends included: numbers that tell words apart, symbols, and tokens a text."""
        codes, found, counts = split_words(column)
        symbols = np.empty(len(found) + 1, np.int64)
        symbols[:-1] = pc.index_in(found, value_set=self.listed).fill_null(self.rare).to_numpy(zero_copy_only=False)
        symbols[-1] = self.end
        words = np.append(word_keys(found), np.uint64(self.end))
        own = symbols != self.rare
        words[own] = symbols[own]
        codes = np.insert(codes, np.cumsum(counts), len(found))
        return words.take(codes), symbols.take(codes), counts + 1


def summed(df: DataFrame, counted: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum of what ``counted`` makes of each task's rows, a vector of whole numbers; empty if there is no task. It is
    summed up piece by piece and in two steps, so that no task gets those of more than about the square root of all."""
    fan = ceil(sqrt(max(1, df.rdd.getNumPartitions())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt, found = TaskContext.get().partitionId() % fan, counted(batches)
        for place, at in enumerate(range(0, len(found), PIECE)):
            if place == 0 or found[at : at + PIECE].any():
                columns = [pa.array([place], pa.int32()), pa.array([salt], pa.int32()), pa.array([found[at : at + PIECE].tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([len(found)], pa.int64())], ["place", "salt", "data", "size"])

    def added(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(data, np.int64) for data in rows.column("data").to_pylist())
        return rows.slice(0, 1).set_column(2, "data", pa.array([total.tobytes()], pa.binary()))

    schema, total = "place int, salt int, data binary, size long", np.zeros(0, np.int64)
    parts = df.mapInArrow(run, schema).groupBy("place", "salt").applyInArrow(added, schema).groupBy("place").applyInArrow(added, schema)
    for r in parts.collect():
        total = total if len(total) else np.zeros(r.size, np.int64)
        total[r.place * PIECE : (r.place + 1) * PIECE] = np.frombuffer(r.data, np.int64)
    return total


def learned_spelling(words: DataFrame) -> Spelling:
    """How all these distinct words (word) are spelled: three passes over them, for characters, contexts and weights."""
    spark = words.sparkSession

    def over(count: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            total = count(pa.array([], pa.string()))
            for batch in batches:
                total += count(batch.column("word"))
            return total

        return summed(words.select("word"), run)

    characters = over(Spelling.characters)
    spelling = Spelling.empty(characters if len(characters) else Spelling.characters([]))
    for step in ("table", "weights"):
        shared = spark.sparkContext.broadcast(spelling)
        found = over(lambda some, step=step: getattr(shared.value, "observed" if step == "table" else "tried")(some))
        shared.destroy()
        if not len(found):
            break
        if step == "table":
            spelling.table = found.reshape(2, -1)
        else:
            spelling = spelling.fitted_to(found)
    return spelling


def part() -> Column:
    """The part that a training document is in, whatever row it is."""
    return F.pmod(F.xxhash64(F.lit("part"), "doc_id", "text"), F.lit(PARTS)).cast("int")


def fitted(docs: DataFrame, vocabulary, model: Mixer, halves: list[list[Table]]) -> tuple[Mixer, float]:
    """The model, fitted to all rows that learn (text, part), each under the tables of the other part; and the chance that a
    rare word is the one that the document predicts, where it predicts a rare word."""
    shared = docs.sparkSession.sparkContext.broadcast([Mixer(model.code, tables) for tables in halves])

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(CELLS + 2, np.int64)
        for batch in sliced(batches, limit=1 << 20):
            for own in range(PARTS):
                some = batch.filter(pc.equal(batch.column("part"), own))
                if some.num_rows:
                    total += shared.value[1 - own].observed(*vocabulary.value.laid(texts(some)))
        return total

    found = summed(docs.select("text", "part"), run)
    shared.destroy()
    if not len(found):
        return model, 0.5
    return model.fitted_to(found), float(found[CELLS + 1] + 1) / float(found[CELLS] + 2)


def context_tables(docs: DataFrame, vocabulary, tokens: int) -> tuple[Callable[[int | None], list[Table]], Callable[[], None]]:
    """The tables of the hashed contexts over all rows that learn (text, part), of about so many tokens: a function that
    gives those of a part, of half as many slots, or of all, and one that forgets them.

    Counts of (context, symbol) are summed up exactly before a context's best symbol and a slot's context are chosen, so
    the tables are the same however rows are dealt to tasks. Contexts are dealt to pages by their hashes, a page for so
    many tokens. Each task hands on the counts of its tokens page by page; a page's are summed up in two steps, so that
    no task gets those of more than about the square root of all.
    """
    slot_bits = min(SLOT_BITS, max(1, (tokens - 1).bit_length()))
    page_bits = min(slot_bits, max(0, (tokens // PAGE_TOKENS).bit_length()))
    part_bits = max(1, slot_bits - 1)
    page_bits = min(page_bits, part_bits)
    bits = [slot_bits, *[part_bits] * PARTS]
    fan = ceil(sqrt(max(1, docs.rdd.getNumPartitions())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(len(ORDERS) * PARTS)]
        salt, size = TaskContext.get().partitionId() % fan, 0

        def handed() -> Iterator[pa.RecordBatch]:
            for kind, numbers in enumerate(held):
                order, own = divmod(kind, PARTS)
                if not numbers:
                    continue
                cut = [(page, c.to_bytes()) for page, c in enumerate(Counts.of(np.concatenate(numbers)).cut(page_bits)) if len(c.numbers)]
                columns = [
                    pa.array(np.full(len(cut), order, np.int32)), pa.array([page for page, _ in cut], pa.int32()),
                    pa.array(np.full(len(cut), own, np.int32)), pa.array(np.full(len(cut), salt, np.int32)), pa.array([data for _, data in cut], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["place", "page", "part", "salt", "data"])
                numbers.clear()

        for batch in sliced(batches, limit=2 << 20):
            for own in range(PARTS):
                some = batch.filter(pc.equal(batch.column("part"), own))
                if some.num_rows:
                    for order, numbers in enumerate(gathered(*_starts(vocabulary.value.laid(texts(some))))):
                        held[order * PARTS + own].append(numbers)
                        size += len(numbers)
            if size > HELD_NUMBERS * len(ORDERS):
                yield from handed()
                size = 0
        if size:
            yield from handed()

    def together(rows: pa.Table) -> Counts:
        return Counts.summed([Counts.from_bytes(data) for data in rows.column("data").to_pylist()])

    def in_part(rows: pa.Table) -> pa.Table:
        return rows.slice(0, 1).drop_columns(["data"]).append_column("data", pa.array([together(rows).to_bytes()], pa.binary()))

    def chosen(rows: pa.Table) -> pa.Table:
        page = rows.column("page")[0].as_py()
        parts = [rows.filter(pc.equal(rows["part"], k)) for k in range(PARTS)]
        each = [together(p) for p in parts if p.num_rows]
        tables = [(0, Counts.summed(each)), *zip([k + 1 for k, p in enumerate(parts) if p.num_rows], each, strict=True)]
        made = [(k, Table.chosen(c, bits[k], page << (bits[k] - page_bits), 1 << (bits[k] - page_bits))) for k, c in tables]
        columns = [
            pa.array([rows.column("place")[0].as_py()] * len(made), pa.int32()), pa.array([page] * len(made), pa.int32()), pa.array([k for k, _ in made], pa.int32()),
            pa.array([t.symbol.tobytes() for _, t in made], pa.binary()), pa.array([t.mark.tobytes() for _, t in made], pa.binary()),
        ]
        return pa.table(columns, names=["place", "page", "kind", "symbol", "mark"])

    schema = "place int, page int, part int, salt int, data binary"
    partial = docs.select("text", "part").mapInArrow(run, schema)
    some = partial.groupBy("place", "page", "part", "salt").applyInArrow(in_part, schema)
    whole = some.groupBy("place", "page").applyInArrow(chosen, "place int, page int, kind int, symbol binary, mark binary")
    found, path = written(whole, "lm-tables")  # so that what was shuffled for them can go

    def tables(own: int | None = None) -> list[Table]:
        kind = 0 if own is None else own + 1
        out = [Table.empty(bits[kind]) for _ in ORDERS]
        driver_tidied(docs.sparkSession)
        for r in found.filter(F.col("kind") == kind).toLocalIterator():  # the tables of a kind have 4 bytes a slot
            slots = 1 << (bits[kind] - page_bits)
            those = slice(r.page * slots, (r.page + 1) * slots)
            out[r.place].symbol[those] = np.frombuffer(r.symbol, np.uint16)
            out[r.place].mark[those] = np.frombuffer(r.mark, np.uint16)
        return out

    return tables, lambda: removed(docs.sparkSession, path)


def _starts(laid):
    words, symbols, counts = laid
    return words, symbols, np.cumsum(counts) - counts


@dataclass
class Facts:
    """What scores need to know: tokens, distinct tokens and ends that were learned, occurrences of rare words, the
    share of them that is spelled out, and the chance that a rare word repeats what the document predicts."""

    n: int
    v: int
    ends: int
    rare: int
    spelled: float
    repeats: float

    def base(self, c):
        return np.log10((c + ADDED) / (self.n + ADDED * (self.v + 1)))


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of each row of docs.

    docs has doc_id, text and held_out; other columns are ignored. The model learns from the rows that aren't held out.

    A text is a sequence of words and an end. Frequent words have symbols, coded bit by bit by a Huffman code; one
    symbol stands for any other word. Each bit is predicted by the symbols' frequencies, by two hashed contexts (what
    followed the word before, and the two words before, most often in all the training texts) and by the document so
    far (what followed the word before the last time). The logistic mixture's weights are chosen by a gate, the trust
    in the predictors, start from a fit to all that learn and are refined block by block as the document goes on. A
    rare word is then what the document predicts, or else drawn by its count or spelled out, by a mixture of contexts
    of characters. score is the log10 of the probability of all tokens, bits_per_byte the same in bits over the text's
    bytes (null if it has none); base_score that of single tokens by smoothed counts.

    Words are counted over all rows, the contexts over all that learn. The fit is to all that learn as well, each
    document under the contexts of the half that it isn't in, and spelling is learned from all rarer words. Counts of
    rare words meet the documents in a join on the word, which no frequent word takes part in. Null texts are empty.
    Repeated rows are scored each; a table without rows that learn, or without rows, is scored all the same. Documents
    are scored one by one, so a score depends on the text and the model alone.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("held_out", F.lit(False)).alias("held_out"))
    learning = docs.filter(~F.col("held_out"))
    words, _ = written(counted(docs.withColumn("learns", ~F.col("held_out"))), "lm-words")
    total, distinct = words.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = learning.count()
    head = frequent_words(words)
    numbers = {r.word: k for k, r in enumerate(head)}
    rare, least = total - sum(r.c for r in head), min((r.c for r in head), default=0)
    frequent = spark.sparkContext.broadcast(numbers)  # SYMBOLS words at most

    tail = words.join(F.broadcast(spark.createDataFrame([(r.word,) for r in head], "word string")), "word", "left_anti")
    once = tail.filter("c = 1").count()
    share = (once + 1.0) / (rare + 2.0)
    spelling = spark.sparkContext.broadcast(learned_spelling(tail.filter("c > 0")))

    vocabulary = spark.sparkContext.broadcast(Vocabulary(numbers))
    learning = learning.select("text", part().alias("part"))
    tables, forget = context_tables(learning, vocabulary, total + ends)
    code = Code(np.array([r.c for r in head] + [max(1, rare), max(1, ends)]))
    model, chance = fitted(learning, vocabulary, Mixer(code, [Table.empty(0) for _ in ORDERS]), [tables(own) for own in range(PARTS)])
    model.tables = tables()
    forget()
    facts = Facts(total + ends, distinct + (ends > 0), ends, rare, share, chance)
    shared = spark.sparkContext.broadcast((Vocabulary(numbers), model, np.array([r.c for r in head] + [0, ends], np.int64), facts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, model, frequencies, facts = shared.value
        base_of = facts.base(frequencies.astype(float))
        repeated, fresh = -log2(facts.repeats), -log2(1 - facts.repeats)
        row = TaskContext.get().partitionId() << 33
        for batch in sliced(batches, limit=2 << 20):
            column = texts(batch)
            words, symbols, counts = vocabulary.laid(column)
            n, starts = len(counts), np.cumsum(counts) - counts
            owners = np.repeat(np.arange(n), counts)
            bits, guessed, told = model.bits(words, symbols, counts)
            base = np.bincount(owners, weights=np.where(symbols == vocabulary.rare, 0.0, base_of[symbols]), minlength=n)
            known = np.bincount(owners, weights=frequencies[symbols] > 0, minlength=n).astype(np.int64)
            rare = np.flatnonzero(symbols == vocabulary.rare)
            told = guessed[rare] & told[rare]
            bits += np.bincount(owners[rare], weights=np.where(told, repeated, np.where(guessed[rare], fresh, 0.0)), minlength=n)
            order = np.lexsort((words[rare], owners[rare]))
            own, keys, told = owners[rare][order], words[rare][order], told[order]
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]) | (keys[1:] != keys[:-1])
            firsts = np.flatnonzero(new)
            uses = np.diff(firsts, append=len(own)).astype(np.int32)
            spelled = np.add.reduceat((~told).astype(np.int32), firsts, dtype=np.int32) if len(firsts) else np.zeros(0, np.int32)
            offsets = np.searchsorted(own[firsts], np.arange(n + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(values)) for values in (keys[firsts].view(np.int64), uses, spelled)]
            columns = [
                pa.array(np.arange(row, row + n)), batch.column("doc_id"), batch.column("held_out"), pa.array(counts.astype(np.int64)),
                pc.binary_length(column).cast(pa.int64()), pa.array(known), pa.array(base), pa.array(bits), *lists,
            ]
            row += n
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["row", "doc_id", "held_out", "n_tokens", "n_bytes", "known", "base", "bits", "keys", "counts", "spelled"]
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_bytes long, known long, base double, bits double, keys array<long>, counts array<int>, spelled array<int>"
    rows, _ = written(docs.mapInArrow(run, schema), "lm-rows")

    def priced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("word")
            c = np.asarray(batch.column("c"), dtype=float)
            keep = c < least
            often = np.flatnonzero(~keep)
            keep[often] = [w not in frequent.value for w in found.take(pa.array(often)).to_pylist()]
            c, found = c[keep], found.filter(pa.array(keep))
            spell = spelling.value.bits(found)
            chance = (1 - share) * c / max(rare, 1) + share * np.exp2(-np.minimum(spell, 1000.0))
            cost = np.where(c > 0, -np.log2(np.maximum(chance, 1e-300)), spell - log2(share))
            keys = word_keys(found).view(np.int64)
            columns = [pa.array(keys), pa.array(c.astype(np.int64)), pa.array(cost)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "c", "cost"])

    prices = words.mapInArrow(priced, "key long, c long, cost double")
    uses = rows.select("row", F.explode(F.arrays_zip("keys", "counts", "spelled")).alias("u")).select("row", F.col("u.keys").alias("key"), F.col("u.counts").alias("n"), F.col("u.spelled").alias("s"))
    one = F.log10((F.col("c") + F.lit(ADDED)) / F.lit(facts.n + ADDED * (facts.v + 1)))
    rest = uses.join(prices, "key").groupBy("row").agg(
        F.sum(F.col("n") * one).alias("rest_base"),
        F.sum(F.col("s") * F.col("cost")).alias("rest_bits"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rest_known"),
    )
    bits = F.col("bits") + F.coalesce("rest_bits", F.lit(0.0))
    return rows.drop("keys", "counts", "spelled").join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(facts.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest_base", F.lit(0.0))).alias("base_score"),
        (-bits * F.lit(log10(2))).alias("score"),
        F.when(F.col("n_bytes") > 0, bits / F.col("n_bytes")).alias("bits_per_byte"),
    )


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id, 10) == 0, F.lit(False))


def op2_lm_scoring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs.withColumn("held_out", held_out(F.col("doc_id"))))


QUERIES = {"op2_lm_scoring": op2_lm_scoring}
ORACLE: dict[str, str] = {}
