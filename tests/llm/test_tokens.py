import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from colsight.llm import tokens

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "\n\n", "Hello, World!", "don't STOP'S it's we'll", "éÉ ñÑ ß İstanbul ΣΑΣ", "café é. x́", "<|endoftext|> a<|startoftext|>b",
    "a b c\x85d\x1ce", "12 3a4 ٣ x²", "日本語 テキスト", "\U0001f600 ok", "word,. word.,! (word) w-w ªº µ", "tab\there\r\nand", "ǅ ﬁ", "'sfoo \"'sx x''t 'S'T'RE 'l l'l a'll'd", "é's ÷×x 1'd2 a<|b <|", "ÀÖØÞß¿¡", "a" * 500,
]


def expected(rows, end=2):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.tokenizer_path())
    result, start = [], 0
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        result.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return result


def test_ids_of_documents_equal_the_library_s(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    found = [tuple(r) for r in tokens.op1_token_files(spark, SF).orderBy("start").collect()]
    assert found == expected(rows)


@pytest.mark.parametrize(("cache", "size"), [(1, 3), (8000, 1 << 20)])
def test_odd_texts_equal_the_library_s(cache, size):
    encoder = tokens.TextIds(tokens.tokenizer_path(), cache, size)
    assert encoder.simple
    texts = [*ODD, "\n".join(t for t in ODD if t), " ".join(t for t in ODD if t and t.isascii())]
    for (_, _, n, crc), text in zip(expected([(0, t) for t in texts]), texts):
        data = encoder.encode(text or "", b"\x02\0\0\0")
        assert (len(data) // 4, zlib.crc32(data)) == (n, crc), text


def test_files_allow_selective_reads(spark, tmp_path):
    path = str(tmp_path / "tokens")
    docs = spark.createDataFrame([(k, f"text number {k} " * 50, f"s{k % 3}", k) for k in range(2000)], "doc_id long, text string, source string, ids long")
    tokens.write_tokens(docs.repartition(5), path, metadata=["source"], row_group_bytes=1 << 14, page_bytes=1 << 10)
    some = tokens.read_tokens(spark, path, 100, 102).orderBy("doc_id").collect()
    index = {r.doc_id: r for r in tokens.read_index(spark, path).collect()}
    assert [(r.doc_id, r.source, r.start) for r in some] == [(k, f"s{k % 3}", index[k].start) for k in (100, 101, 102)]
    assert all(len(r.ids) == r.n_tokens and r.ids[-1] == 2 for r in some)
    file = pq.ParquetFile(sorted((tmp_path / "tokens").glob("part-*"))[0])
    column = {file.metadata.row_group(0).column(k).path_in_schema: file.metadata.row_group(0).column(k) for k in range(file.metadata.num_columns)}
    assert "DELTA_BINARY_PACKED" in column["doc_id"].encodings and column["doc_id"].has_offset_index
    ids = next(c for p, c in column.items() if p.startswith("ids"))
    assert "RLE_DICTIONARY" in ids.encodings and ids.has_offset_index
    assert file.metadata.num_row_groups > 1
    plan = tokens.read_index(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ids:array" not in plan


def test_nulls_repeated_ids_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([(None, "b"), (3, None), (3, "a"), (1, ""), (None, None)], "doc_id long, text string")
    tokens.write_tokens(docs, str(tmp_path / "a"))
    rows = sorted(((r.start, r.doc_id, r.n_tokens) for r in tokens.checksums(tokens.read_tokens(spark, str(tmp_path / "a"))).collect()))
    assert [(s, d, n) for s, d, n in rows] == [(0, None, 1), (1, None, 2), (3, 1, 1), (4, 3, 1), (5, 3, 2)]
    tokens.write_tokens(docs.limit(0), str(tmp_path / "b"))
    assert tokens.checksums(tokens.read_tokens(spark, str(tmp_path / "b"))).count() == 0


def test_one_doc_id_for_all_rows_fills_several_files(spark, tmp_path):
    path = str(tmp_path / "tokens")
    rows = [(7, f"{k % 90:02d} text {k}") for k in range(400)] + [(None, f"{k} none") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tokens.write_tokens(docs, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    index = tokens.read_index(spark, path).orderBy("start").collect()
    assert len(list((tmp_path / "tokens").glob("part-*.parquet"))) > 2
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r.doc_id, r.start, r.n_tokens) for r in index] == [e[:3] for e in expected(ordered)]


def test_clashing_names(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, part long")
    with pytest.raises(ValueError, match="part"):
        tokens.write_tokens(docs, str(tmp_path / "x"), metadata=["part"])
    tokens.write_tokens(docs, str(tmp_path / "y"))
