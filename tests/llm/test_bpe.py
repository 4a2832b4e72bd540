"""BPE against the tokenizers library, the transducer against a dictionary."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from heronry.llm import bpe
from heronry.llm.lexicon import Automaton, Lexicon, compiled

FOLDER = "/root/testdata/sf0.001"
FILE = bpe.default_path()
ODD = [
    "", " ", "  ", "\n", " \n ", "a  b", "a   b\n\n c", "don't 're we've I'LL he'll x'd 'sabc's", "''s !'s  's\n's\t'm", "it's'", "'", "'r", "'re", "'l", "x 'll", "12ab34 ½ ²x", "É é ñ ß", "日本語 テキスト", "a b　c  d", "\x1c\x1d a", "🙂🙂 👍🏽", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", " <|endoftext|>  's", "<|endoftext|", "Ᲊx Ɤ1 \U000105c0\U000105c1", "á ‍﻿", "\r\n\r\n  x\r\n", "word " * 3000, "a" * 5000, " " * 3000 + "b", "퟿\U0010ffff", "1'st", "can't've", "'S'T", "x\u0085y", "...' m", "don’t",
]


def library():
    t = Tokenizer.from_file(FILE)
    t.no_padding()
    t.no_truncation()
    return t


def expected(rows):
    t = library()
    for d, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        yield d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def same(df, rows):
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(expected(rows), key=repr)


@pytest.mark.parametrize("options", [{}, {"step_bytes": 20}, {"most": 0}, {"most": 50, "least": 1}])
def test_edges(spark, options):
    rows = [*enumerate(ODD), (None, None), (3, "a b"), (3, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS bpe_ids", "'x' AS word")
    same(bpe.report(df, **options), rows)


def test_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    same(bpe.report(docs), [tuple(r) for r in docs.collect()])


def test_random_strings():
    """Words of random code points, among them some that Python's tables don't know."""
    draw, vocab, t = random.Random(4), bpe.vocabulary(FILE), library()
    pools = ["ab '", "a 1'st\n", "".join(map(chr, range(32, 127))), "".join(map(chr, range(0x80, 0x500))), "".join(chr(draw.randrange(0xE000, 0x30000)) for _ in range(3000)), "".join(map(chr, bpe.SPACES)) + "ab'1"]
    texts = ["".join(draw.choice(draw.choice(pools)) for _ in range(draw.randrange(60))) for _ in range(3000)]
    texts += ["".join(draw.choice(pool) for _ in range(40)) for pool in pools for _ in range(300)]
    got = [ids.tolist() for _, ids in bpe.encoded(pa.array(texts), vocab, None, 1 << 16)]
    assert got == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_classes_are_the_vocabulary_s():
    """Each code point that Python's tables hold forms words as in the tokenizer file (every 37th, and all below U+3000)."""
    cut, table = library().pre_tokenizer.pre_tokenize_str, bpe.classes()
    for c in [*range(0x3000), *range(0x3000, 0x110000, 37)]:
        if 0xD800 <= c < 0xE000 or table[c] == bpe.UNKNOWN:
            continue
        forms = [len(cut(x + chr(c))) == 1 for x in "a1!"]
        want = bpe.LETTER if forms[0] else bpe.NUMBER if forms[1] else bpe.OTHER if forms[2] else bpe.SPACE
        assert table[c] == want or chr(c) == "'", hex(c)


def test_long_words_and_texts():
    vocab, t = bpe.vocabulary(FILE), library()
    draw = random.Random(1)
    for word in ["a" * 30000, "".join(draw.choice("etaoin") for _ in range(20000)), "é" * 3000, "-" * 999]:
        assert vocab.merge(word.encode()) == t.encode(word, add_special_tokens=False).ids
    text = " ".join(draw.choice(["alpha", "beta's", "  ", "1234", "\n", "x<|endoftext|>y"]) for _ in range(50000))
    parts = list(bpe.encoded(pa.array(["a", text, None]), vocab, None, 1000))
    assert len(parts) > 50 and np.concatenate([i for k, i in parts if k == 1]).tolist() == t.encode(text, add_special_tokens=False).ids


def test_bytes_that_are_not_text():
    vocab, raw = bpe.vocabulary(FILE), b"ok \xff\xe2\x82 \xf0\x9f end"
    broken = pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, len(raw)], np.int32)), pa.py_buffer(raw)])
    assert [i.tolist() for _, i in bpe.encoded(broken, vocab, None, 100)] == [library().encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids]


def test_automaton_is_minimal_and_finds_its_words():
    draw = random.Random(2)
    words = sorted({bytes(draw.choice(b"abc\x00\xff") for _ in range(draw.randrange(1, 7))) for _ in range(2000)})
    a = Automaton(words)
    language = {}  # equal right languages would be two states with one signature
    for state in a.order:
        language[state] = (a.final[state], tuple(sorted((b, id(language[t])) for b, t in a.arcs[state].items())))
    assert len({(a.final[s], tuple(sorted(a.arcs[s].items()))) for s in a.order}) == len(a.order) and a.below[0] == len(words)
    lexicon = Lexicon(compiled(words, [[k, k + 1] for k in range(len(words))]))
    asked = [*words, b"", b"d", *(bytes(draw.choice(b"abcd\x00\xff") for _ in range(draw.randrange(1, 9))) for _ in range(2000))]
    ends = np.cumsum([len(w) for w in asked])
    place = lexicon.places(np.frombuffer(b"".join(asked), np.uint8), ends - [len(w) for w in asked], ends)
    known = {w: k for k, w in enumerate(words)}
    assert place.tolist() == [known.get(w, -1) for w in asked]


def test_round_trip_of_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(40)
    back = bpe.decode(bpe.encode(docs, bpe.build_lexicon(docs)))
    assert back.columns == [*docs.columns, "bpe_ids", "bpe_text"]
    assert all((r["text"] or "") == r["bpe_text"] for r in back.collect())
    odd = spark.createDataFrame([([1, -5, 99999999],), (None,), ([],)], "bpe_ids array<int>")
    assert [r["bpe_text"] for r in bpe.decode(odd).collect()] == ['"', "", ""]


def test_empty(spark):
    assert bpe.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
