import random
from array import array

import pytest

from maskwell.llm import tokens

NAMES = [tokens.BYTE_BPE, tokens.WORD_BPE]
BITS = ["the", "Über", "naïve", "ǅ", "İstanbul", "ΑΣ", "ſ", "ß", "don't", "I'LL", "12345", "3.14", ".", ",", "!!", " ", "  ", "\n", "\n\n", "\t", " \n ", "\x85", " ", "​", "　", "é", "́", "日本語", "😀", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "\\u0041", "a" * 50, "\x1c", "\x00", "­", "Wort.", "MOT,", "été.", "É,"]


def library(name, text):
    return tokens.Coder.at(tokens.tokenizer_path(name)).library_ids(text)


@pytest.mark.parametrize("name", NAMES)
def test_parts_equal_the_library(name):
    rng, coder = random.Random(5), tokens.Coder.at(tokens.tokenizer_path(name))
    for _ in range(4000):
        text = "".join(rng.choice(BITS) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(12)))
        assert list(array("I", coder.ids(text))) == library(name, text), repr(text)


@pytest.mark.parametrize("name", NAMES)
def test_every_character_alone_and_between(name):
    coder = tokens.Coder.at(tokens.tokenizer_path(name))
    for code in [*range(0x0, 0x3100), *range(0xFE00, 0x10000, 3), *range(0x1F300, 0x1F700, 5)]:
        for text in (f"a{chr(code)} b", f"a {chr(code)}b. c{chr(code)}, d"):
            assert list(array("I", coder.ids(text))) == library(name, text), hex(code)


@pytest.mark.parametrize("name", NAMES)
def test_chunks_are_spliced(name):
    rng, coder = random.Random(6), tokens.Coder.at(tokens.tokenizer_path(name))
    for k in range(300):
        bits = BITS if k % 3 else ["x", "日", "\n", "12", "é"]
        text = "".join(rng.choice(bits) + rng.choice(["", " ", " "] if k % 3 else [""]) for _ in range(rng.randrange(300)))
        assert [k for coded, n, _ in coder.spliced(text, 64, 4) for k in coded.ids[:n]] == library(name, text), repr(text)
        assert coder.count(text, chunk=64, overlap=4)[0] == len(library(name, text))


def test_counts(spark):
    texts = [None, "", "hello world", "hello world", "word " * 30000, "x" * 90000]
    docs = spark.createDataFrame([(k, t, 7) for k, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in tokens.token_counts(docs).collect()}
    for k, t in enumerate(texts):
        n = len(library(tokens.BYTE_BPE, t or ""))
        assert (got[k].n_tokens, got[k].n_bytes, got[k].over_limit) == (n, len((t or "").encode()), n > 1024)
    assert got[4].n_splices > 30 and got[4].n_widened == 0 and got[5].n_splices == 0 and got[5].n_widened > 0
    assert tokens.token_counts(docs.limit(0)).count() == 0


def test_ordinary_documents_are_spliced(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in tokens.token_counts(docs).collect()}
    for row in docs.toLocalIterator():
        assert got[row.doc_id].n_tokens == len(library(tokens.BYTE_BPE, row.text or ""))
    assert sum(r.n_splices > 0 for r in got.values()) > len(got) // 20


@pytest.mark.parametrize("name", NAMES)
def test_real_texts(spark, name):
    coder = tokens.Coder.at(tokens.tokenizer_path(name))
    for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").toLocalIterator():
        assert list(array("I", coder.ids(row.text))) == library(name, row.text)


def test_known_parts_take_bounded_bytes():
    coder = tokens.Coder(tokens.tokenizer_path(tokens.BYTE_BPE))
    coder.room = 3000
    for k in range(200):
        coder.ids(f"part{k} 第{k}部分{'文' * 100} x")
    assert 0 <= coder.room < 3000 and all(len(p) <= tokens.MEMO_PART for p in coder.memo)


def test_words_between_marks_and_lines_equal_the_library():
    rng, coder = random.Random(7), tokens.Coder(tokens.tokenizer_path(tokens.WORD_BPE))
    bits = ["don", "'s", "'", "t", "(", ")", "###", "$", "Über", "É", "ß", "µ", "²", "×", "\n", "\n", " ", "\r\n", "\t", "\x85", "\xa0", "<|endoftext|>", "<|EndOfText|>", "<|", "|>", "endoftext", "_", "``", "9", "é", "́", "ſ", "İ", "’", "ΑΣ", "​", "x" * 70]
    for k in range(8000):
        coder.room = 5000 if k % 50 == 0 else coder.room
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(10)))
        assert list(array("I", coder.ids(text))) == library(tokens.WORD_BPE, text), repr(text)
    for code in [*range(0x0, 0x3100), *range(0xFE00, 0x10000, 3)]:
        for text in (f"a{chr(code)}\n{chr(code)}b", f"B {chr(code)}\n\nA{chr(code)}!"):
            assert list(array("I", coder.ids(text))) == library(tokens.WORD_BPE, text), hex(code)


def test_known_words_need_no_encoding_in_other_forms():
    coder = tokens.Coder(tokens.tokenizer_path(tokens.WORD_BPE))
    coder.ids("alpha beta . !! ( ###")
    coder.library_ids = coder.model = None
    for text in ("ALPHA Beta.\nAlpha!!\nbeta###", "(Alpha\n\nBETA  alpha###"):
        assert list(array("I", coder.ids(text))) == library(tokens.WORD_BPE, text)
