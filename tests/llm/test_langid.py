import math
import unicodedata
import zlib

import pytest

from kinweave.llm.langid import WINDOW, fit, identify, is_held_out, labelled_sample, to_bytes, windows
from tests.llm.helpers import odd_docs


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = fit(docs, size=2000)
    rows = identify(docs, net, keep=("lang",)).withColumn("held", is_held_out()).collect()
    held = [r for r in rows if r["held"]]
    assert {r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows} == {True}
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)
    # The sample is bounded and leaves the held-out rows alone.
    sample = labelled_sample(docs, "doc_id", "text", "lang", 100)
    assert len(sample) <= 100 and {lang for lang, _ in sample} == {"en", "de", "fr", "es"}


def test_odd_rows(spark):
    df = odd_docs(spark, ["the cat sat", "123 !!"]).selectExpr("*", "'q' AS lang_pred", "0 AS score")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(df, fit(df)).collect()}
    assert got[0] == got[1] == got[3] == got[13] == ("und", 0.0) and got[12][0] == "en"
    assert set(identify(df, None).select("lang_pred").distinct().collect()) == {("und",)}
    assert fit(df.limit(0)) is None and identify(df.limit(0), None).count() == 0


@pytest.mark.parametrize("n", [0, 1, 95, 96, 97, 500])
def test_windows_hold_every_byte(n):
    data = to_bytes("a" * n)
    x, held = windows(data)
    assert held.sum() == n and (x > 0).sum() == n


def test_letters_are_of_category_l(spark):
    texts = ["½²", "①", "Ⅷ", "¼ ³", "_ 7", "", None, "ª", "ʰ", "x½"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(i + 20, "the cat") for i in range(40)], "doc_id bigint, text string").selectExpr("*", "'en' AS lang")
    got = {r["doc_id"]: r["lang_pred"] for r in identify(df, fit(df)).collect()}
    assert [i for i, t in enumerate(texts) if got[i] == "und"] == [i for i, t in enumerate(texts) if not any(unicodedata.category(c)[0] == "L" for c in t or "")]
    assert got[0] == got[1] == got[2] == "und" and got[7] == "en"


def plain_prediction(net, text):
    """The forward pass without arrays: a window, a filter, a place at a time."""
    data = list(to_bytes(text))
    total, held = [0.0] * len(net.labels), 0
    for at in range(0, max(1, len(data)), WINDOW):
        own = data[at : at + WINDOW]
        window = own + [0] * (WINDOW - len(own))
        pooled = []
        for table, bias in zip(net.tables, net.bias, strict=True):
            for f in range(table.shape[2]):
                best = max(sum(float(table[k, window[i + k], f]) for k in range(len(table))) for i in range(WINDOW - len(table) + 1))
                pooled.append(max(0.0, best + float(bias[f])))
        z = [sum(p * float(net.out[i, c]) for i, p in enumerate(pooled)) + float(net.out_bias[c]) for c in range(len(net.labels))]
        norm = math.log(sum(math.exp(x - max(z)) for x in z)) + max(z)
        total = [t + len(own) * (x - norm) for t, x in zip(total, z, strict=True)]
        held += len(own)
    p = [math.exp(t / held) for t in total]
    return net.labels[p.index(max(p))], max(p) / sum(p)


def test_predictions_equal_a_plain_forward_pass(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    net = fit(docs, size=400)
    rows = [r for r in identify(docs, net, keep=("text",)).collect() if r["text"] and len(r["text"]) < 600][:25]
    assert len(rows) == 25
    for r in rows:
        label, score = plain_prediction(net, r["text"])
        assert r["lang_pred"] == label and r["score"] == pytest.approx(score, abs=1e-4)


def test_more_labels_than_a_sample_holds(spark):
    df = spark.range(200).selectExpr("id AS doc_id", "'some text' AS text", "concat('l', id) AS lang")
    with pytest.raises(ValueError, match="labels"):
        labelled_sample(df, "doc_id", "text", "lang", 50)
    assert 0 < len(labelled_sample(df, "doc_id", "text", "lang", 500)) <= 500
