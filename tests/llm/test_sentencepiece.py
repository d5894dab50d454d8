import random
import subprocess
import sys

import numpy as np
import pytest

spm = pytest.importorskip("sentencepiece")
P = pytest.importorskip("public_tokenizers")

from kinweave.llm import sentencepiece as sp
from kinweave.llm.sentencepiece import MARK, Decoder, Encoder, Model, decode, encode, round_trip

FILE = P.path("piece_bpe_32k.model")
ODD = [
    "", " ", "   ", "a", "a  b", "  lead", "trail   ", "\n", "a\nb", " \n \n", "\t x\t", "héllo wörld", "日本語 テキスト",
    MARK, f"x{MARK}{MARK}y", "ﬁ ½", "a\u0000b", "\U0001f600 x  \U0001f600", "<s> hi </s> <0x0A> <unk>", "\r\n", "é dé",
    "aaaaaaaaaaaaaaaa" * 9, "word" * 3000, "x" + " " * 40 + "y", " " * 23, "!!!???...", "&&&%%%$$$###", "1234567890" * 5,
]


@pytest.fixture(scope="module")
def tools():
    with open(FILE, "rb") as f:
        model = Model(f.read())
    return Encoder(model), Decoder(model), spm.SentencePieceProcessor(model_file=FILE)


def test_odd_texts_equal_the_library(tools):
    encoder, decoder, library = tools
    assert encoder.encode(ODD) == library.encode(ODD)
    for text in ODD:
        assert decoder.decode(library.encode(text)) == text.replace(MARK, " ")


def test_random_texts_equal_the_library(tools):
    encoder, _, library = tools
    r = random.Random(5)
    syllables = ["th", "er", "in", "tion", "é", "ç", "eau", "sch", "ü", "ß", "le", "ción", "A", "Z", ".", ",", "!", "the", "ing", " ", "  ", "\n", "0", "q", "日"]
    texts = ["".join(r.choice(syllables) for _ in range(r.randrange(60))) for _ in range(3000)]
    letters = ["".join(r.choice("abet isnoé") for _ in range(r.randrange(40))) for _ in range(3000)]
    assert encoder.encode(texts) == library.encode(texts)
    assert encoder.encode(letters) == library.encode(letters)


def test_long_words_equal_the_library(tools):
    encoder, decoder, library = tools
    r = random.Random(6)
    symbols = "ABCDEFGHIJabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = [
        "x" * 30_000, "ab" * 20_000, "aaab" * 5000, "日本語テキスト" * 2000, "".join(r.choices(symbols, k=60_000)), "é" * 5000 + "\n" + "z" * 9999,
        "go " + "thequickbrownfox" * 1000 + " on", "-" * 4095 + "a", "-" * 4096 + "a", "\U0001f600" * 5000,
    ]
    assert encoder.encode(texts) == library.encode(texts)
    assert [decoder.decode(x) for x in encoder.encode(texts)] == texts


A_LONG_WORD = """
import resource, sys
import numpy as np
from kinweave.llm.sentencepiece import Decoder, Encoder, Model
model = Model(open(sys.argv[1], "rb").read())
encoder, decoder = Encoder(model), Decoder(model)
text = "x" * 2_500_000 + "thequickbrownfoxjumpsoverthelazydog" * 71_429
encoder.encode([text[:40_000]])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
(ids,) = encoder.encode_batch([text])
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before, len(encoder.cache))
assert decoder.decode(np.frombuffer(ids, np.int32).tolist()) == text
"""


def test_a_word_of_5_mb_takes_little_memory():
    found = subprocess.run([sys.executable, "-c", A_LONG_WORD, FILE], capture_output=True, text=True, timeout=300)
    kilobytes, kept = map(int, found.stdout.split())
    assert kilobytes < 100_000 and kept == 0


def test_kept_words_are_bounded_in_bytes(tools, monkeypatch):
    encoder, _, library = tools
    monkeypatch.setattr(sp, "CACHE_BYTES", 20_000)
    r = random.Random(8)
    for _ in range(30):
        texts = ["".join(r.choices("abcdefgh ", k=400)) for _ in range(20)]
        assert encoder.encode(texts) == library.encode(texts)
    assert encoder.held < 20_000 + 400 * 20 * 200


def test_frames_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(99, None), (0, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS ids", "text AS lang")
    encoded = encode(df, FILE)
    assert encoded.count() == len(rows)
    got = {(r["doc_id"], r["text"]) for r in decode(encoded, FILE).collect()}
    assert got == {(i, (t or "").replace(MARK, " ")) for i, t in rows}
    both = {(r["doc_id"], tuple(r["ids"]), r["text"]) for r in round_trip(df, FILE).collect()}
    assert both == {(r["doc_id"], tuple(r["ids"]), r["text"]) for r in decode(encoded, FILE).collect()}
    assert encode(df.limit(0), FILE).count() == round_trip(df.limit(0), FILE).count() == 0
    lists = spark.createDataFrame([(1, None), (2, []), (None, [1000]), (None, [1000])], "doc_id bigint, ids array<int>").selectExpr("*", "'x' AS text")
    assert sorted((r["doc_id"] or 0, r["text"] == "") for r in decode(lists, FILE).collect()) == [(0, False), (0, False), (1, True), (2, True)]


def test_unigram_model_takes_the_best_sum():
    def field(n, value):
        if isinstance(value, int):
            return bytes([n << 3, value]) if value < 128 else None
        if isinstance(value, float):
            import struct

            return bytes([n << 3 | 5]) + struct.pack("<f", value)
        return bytes([n << 3 | 2, len(value)]) + value

    def big(n, value):
        head = n << 3
        return bytes([head & 127 | 128, head >> 7, value])

    pieces = [("<unk>", 0.0, 2)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    scored = {MARK: -3.0, "a": -2.0, "b": -2.0, "ab": -1.5, MARK + "a": -2.5, "bb": -1.0}
    pieces += [(p, s, 1) for p, s in scored.items()]
    data = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in pieces)
    data += field(2, field(3, 1) + big(35, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))
    model = Model(data)
    encoder = Encoder(model)
    names = lambda t: [model.pieces[i] for i in encoder.encode([t])[0]]
    assert names("abb") == [MARK + "a", "bb"]
    assert names("ab") == [MARK, "ab"] or names("ab") == [MARK + "a", "b"]
    assert names("c") == [MARK, "<0x63>"]
