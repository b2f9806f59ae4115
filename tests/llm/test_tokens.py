import glob
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from quillspark.llm import tokens
from quillspark.llm.shared import new_path
from quillspark.llm.tokens import VOCABULARY, ChunkEncoder, checksums, op1_token_output, public_vocabulary, read_index, read_tokens, write_tokens

ODD = ["", None, "  ", "a\nb\tc\x0bd e f", "It's <|endoftext|> I'LL 'd", "é ́x Å ΣΣ ẛ̣", "x" * 5000, "word " * 30000, "中文 日本\r\n\x1c\x85z", "ÉTÉ. Çà, Ñandú; Straße: ÿÿ. İI. e\u0301. \u0301. a.\u0338 h\u0331. H\u0331! ŸŒ,", "don't. [x]. (y), \"z.\" a.b,c;d...e", "same", "same"]

#: Counts what is taken of it; it has to outlive that.
COUNTED = pa.proxy_memory_pool(pa.default_memory_pool())


def brute(rows):
    tokenizer, at, out = Tokenizer.from_file(public_vocabulary()), 0, []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    got = sorted(map(tuple, op1_token_output(spark, "/root/testdata/sf0.01").collect()))
    assert got == brute(map(tuple, docs))


def test_odd_texts_and_round_trip(spark):
    rows = [(i // 2 if i else None, t, "old", 7) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens string, part int").repartition(3)
    path = new_path(spark, "tokens-test")
    write_tokens(docs, path, public_vocabulary())
    rows = [r[:2] for r in rows]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    got = sorted(map(tuple, checksums(spark, path).collect()), key=lambda r: r[1])
    assert got == brute(order)
    tokenizer = Tokenizer.from_file(public_vocabulary())
    some = read_tokens(spark, path, 3, 3).collect()
    assert sorted(r.tokens for r in some) == sorted(tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for d, t in rows if d == 3)
    assert "tokens" not in read_index(spark, path).columns
    files = [pq.ParquetFile(f) for f in glob.glob(path.removeprefix("file:") + "/tokens/*.parquet")]
    columns = [f.metadata.row_group(0).column(k) for f in files if f.metadata.num_rows for k in range(5)]
    assert all(c.has_offset_index and c.has_column_index for c in columns)
    assert any("DELTA_BINARY_PACKED" in c.encodings for c in columns if c.path_in_schema == "part_start")
    assert any("RLE_DICTIONARY" in c.encodings for c in columns if c.path_in_schema.startswith("tokens"))


def test_empty_table(spark):
    path = new_path(spark, "tokens-empty")
    write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, public_vocabulary())
    assert checksums(spark, path).count() == 0


def test_other_vocabularies_get_whole_texts():
    text = ["Two words, and  more.\n\nSo it goes", "", "x  y", " é" * 50]
    for name, apart in ((VOCABULARY, True), ("byte_bpe_50k.json", False)):
        path = public_vocabulary(name)
        encoder, tokenizer = ChunkEncoder(path), Tokenizer.from_file(path)
        assert encoder.apart == apart
        ids, counts = encoder.encode(pa.array(text), 2)
        want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in text]
        assert ids.to_pylist() == [k for w in want for k in w] and counts.tolist() == list(map(len, want))


def test_encoding_takes_little_memory_beside_the_texts(spark, monkeypatch, tmp_path):
    text = pa.array(["".join(f"word{k * k % 997} of, the{k % 89}. line\n" for k in range(at, at + 200)) for at in range(1000)])
    encoder, before = ChunkEncoder(public_vocabulary()), pa.default_memory_pool()
    pa.set_memory_pool(COUNTED)
    try:
        encoder.encode(text, 2)
    finally:
        pa.set_memory_pool(before)
    assert COUNTED.max_memory() < 6 * text.nbytes

    known, seen = tokens._encoder, str(tmp_path / "sizes")

    def recording(path):
        class Recording:
            forget = known(path).forget

            def encode(self, column, end_id):
                with open(seen, "a") as f:
                    print(sum(len(t.as_py().encode()) for t in column), file=f)
                return known(path).encode(column, end_id)

        return Recording()

    monkeypatch.setattr(tokens, "_encoder", recording)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(text.to_pylist())] * 2, "doc_id long, text string")
    monkeypatch.setattr(tokens, "partitions", lambda docs: 1)
    write_tokens(docs, new_path(spark, "tokens-large"), public_vocabulary())
    sizes = [int(n) for n in open(seen)]
    assert sum(sizes) == 2 * sum(len(t) for t in text.to_pylist()) and max(sizes) <= 4.1 * 2**20
