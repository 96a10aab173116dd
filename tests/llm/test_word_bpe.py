"""Word-level BPE against the tokenizers library, whole texts at a time."""

import random
import struct

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from loomgraph.llm import word_bpe
from tests.llm.conftest import prose

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return word_bpe.Vocabulary(PATH)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return struct.pack(f"<{len(ids)}I", *ids), library.decode(ids, skip_special_tokens=False).encode()


def check(library, rows, out):
    got = sorted(((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in out.toLocalIterator()), key=repr)
    assert got == sorted(((i, *expected(library, t)) for i, t, *_ in rows), key=repr)


ODD = [
    "it's we're I'll they'd I'm you've can't 'tis ''s !'s 's's '' ' rock'n'roll 'RE'VE", "x" * 5000 + " y", "a1b22c٣४ Ⅷ½ x²", "ÉÈ é ﬁ Ǆ İstanbul ΣΊΣΥΦΟΣ Å",
    "tab\tnew\nline\x0b\x0c\r\x1c\x85\xa0 　end", "日本語 かな ﾊﾝｶｸ 한국어 한", "<|endoftext|>a<|startoftext|><|endoftext|> b<|endoftext|", "👍🏽 emoji‍z \U0001f1e9\U0001f1ea",
    "...!!!??? -- §$%&/()=`´", "́́abḉ", "a\u0000b�﻿", " ", "'", "'s", "don<|endoftext|>'t", "ʼn ŉ ’s it’s", "ẞ ẞ ß",
]


def test_ids_and_texts_are_the_librarys(spark, frame, odd_rows, library, vocabulary):
    rows = odd_rows + [(100 + i, t) for i, t in enumerate(ODD)] + [(200 + i, prose(i, 60)) for i in range(40)] + [(300, "z" * 70_000), (301, prose(9, 150_000))]
    check(library, rows, word_bpe.encode(frame(rows).repartition(3), vocabulary))


def test_few_or_no_frequent_words_give_the_same(spark, frame, odd_rows, library, vocabulary):
    rows = odd_rows + [(100 + i, t) for i, t in enumerate(ODD)] + [(200 + i, prose(i % 5, 60)) for i in range(20)]
    for limit in (0, 40):
        check(library, rows, word_bpe.encode(frame(rows), vocabulary, rows=limit))


def test_random_characters(spark, frame, library, vocabulary):
    random_ = random.Random(5)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    low = [c for c in points if c < 0x500]
    rows = [(i, "".join(chr(random_.choice(points if i % 3 == 0 else low)) for _ in range(200))) for i in range(150)]
    check(library, rows, word_bpe.encode(frame(rows), vocabulary))


def test_empty_table(spark, frame, vocabulary):
    out = word_bpe.encode(frame([]), vocabulary)
    assert out.count() == 0 and out.columns == ["doc_id", "ids", "decoded"]


def test_table_of_words_holds_each_once(spark, frame, library, vocabulary):
    words = word_bpe.word_table(frame([(1, "A b a'S"), (2, "a <|endoftext|>")]).select("text"), vocabulary)
    got = {r.word: (r.n, r.ids, r.decoded) for r in words.toLocalIterator()}
    assert {w: n for w, (n, _, _) in got.items()} == {"a": 3, "b": 1, "'s": 1}
    assert all(ids == library.encode(w).ids and decoded == library.decode(ids) for w, (_, ids, decoded) in got.items())


def test_other_vocabularies_are_refused():
    with pytest.raises((ValueError, KeyError)):
        word_bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


def test_codes_of_rare_words_take_no_more_bytes_than_the_ids_need(vocabulary):
    batch = pa.RecordBatch.from_arrays([pa.array(["ab", "c"]), pa.array([[1, 65535], [7]], pa.list_(pa.int32())), pa.array(["a b", "c"])], names=["word", "ids", "decoded"])
    for kind, width in ((word_bpe._id_kind(vocabulary), 2), ("<u4", 4)):
        (out,) = word_bpe._with_code(kind)([batch])
        codes = out.column(1).to_pylist()
        assert [len(c) for c in codes] == [4 + 2 * width + 3, 4 + width + 1]
        read = word_bpe._read_codes(codes, kind)
        assert read.ids.tolist() == [1, 65535, 7] and read.data.tobytes() == b"a b c "


def test_one_worker_adds_up_and_encodes_the_words_of_its_buckets(library, vocabulary, monkeypatch):
    monkeypatch.setattr(word_bpe, "_ENCODED", 7)
    texts = [prose(i, 60) for i in range(4)]
    counted = word_bpe._counted(word_bpe._splitter(vocabulary))
    parts = [pa.Table.from_batches(counted(iter([pa.RecordBatch.from_arrays([pa.array([t])], names=["text"])]))) for t in texts]
    parts = pa.concat_tables(parts).sort_by("bucket").to_batches(max_chunksize=5)
    found = list(word_bpe._encoded(vocabulary)(iter(parts)))
    assert all(b.num_rows <= 7 for b in found)
    rows = {r["word"]: r for b in found for r in b.to_pylist()}
    counts = {}
    for text in texts:
        for word, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text)):
            word = bytes(word_bpe.byte_characters().index(c) for c in word).decode()
            counts[word] = counts.get(word, 0) + 1
    assert {w: r["n"] for w, r in rows.items()} == counts and sum(b.num_rows for b in found) == len(counts)
    assert all(r["ids"] == library.encode(w, add_special_tokens=False).ids for w, r in rows.items())
