"""Stages on tables with columns of any name and type, hot null ids, and the classifier against plain Python."""

import hashlib
import math
import zlib

import zstandard
from pyspark.sql import functions as F

from tidepool.llm import bpe, jaccard, mixing, quality, secrets
from tests.llm.test_queries import make, write

ODD = "doc_id long, text string, lang string, source string, n_chars string, `a.b` string, `c``d` int, tags map<string,int>, nested struct<text:string,`x.y`:int>, copies string"


def odd_docs(spark, rows):
    made = [(i, t, "en", s, "many", "dotted", 7, {"k": 1}, ("inner", 2), "kept") for i, t, s in rows]
    return spark.createDataFrame(made, ODD).repartition(3)


def others(df):
    return df.select("lang", "n_chars", F.col("`a.b`"), F.col("`c``d`"), F.to_json("tags"), F.to_json("nested"), "copies").distinct().collect()


def test_stages_keep_columns_of_any_name_and_type(spark, tmp_path):
    rows = make()
    rows += [rows[0], rows[0], (None, rows[1][1], "web"), (None, None, None)]
    folder = write(spark, tmp_path, rows)
    docs = odd_docs(spark, rows)
    for stage in (quality.keep_good, jaccard.keep_one, secrets.redact_documents, mixing.mix_documents):
        out = stage(spark, docs, folder)
        assert out.schema.simpleString() == docs.schema.simpleString(), stage
        assert list(map(tuple, others(out))) == [("en", "many", "dotted", 7, '{"k":1}', '{"text":"inner","x.y":2}', "kept")], stage
    assert bpe.tokenize(spark, docs, folder).count() == len(rows)
    assert "<assign>" in secrets.redact_documents(spark, docs, folder).where("doc_id = 307").first()["text"]


def test_redacted_length_is_counted_where_it_is_a_number(spark):
    docs = spark.createDataFrame([(1, "x password=abcdefgh12345 y", 26), (2, "clean", 99), (3, None, None)], "doc_id int, text string, n_chars int")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in secrets.redact_documents(spark, docs, "").collect()}
    assert got[2] == ("clean", 99) and got[3] == (None, None)
    assert got[1][1] == len(got[1][0]) and "abcdefgh" not in got[1][0]


def test_rows_that_differ_elsewhere_are_one_document(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", "web", x) for x in "zya"] + [(2, "a b c d e f g", "web", "q")], "doc_id long, text string, source string, more string")
    assert [tuple(r) for r in jaccard.keep_one(spark, docs, "").collect()] == [(1, "a b c d e f g", "web", "a")]


def test_null_ids_spread_over_blocks(spark):
    """A third of all rows without an id: no block of documents holds more than a small share of them."""
    rows = [(None if i % 3 == 0 else i, "web", 1 + i % 97) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    hashes = df.select(mixing._md5("doc", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")).alias("h"), "doc_id")
    assert hashes.where("doc_id IS NULL").groupBy("h").count().agg(F.max("count")).first()[0] <= 3000 / 90
    assert mixing.mix(df).count() == 3000


# --- the classifier, written anew: own selection, own dictionaries, own calibration ---------------------------------------------
def plain_scores(rows, piece):
    text = {i: t or "" for i, t, _ in rows if i is not None}
    labels = {i: int(i % 4 != 3) for i in text if i < 160 and zlib.crc32(str(i).encode()) % 5}
    by = {q: sorted((i for i in labels if labels[i] == q), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()) for q in (0, 1)}
    dictionary = {}
    for q in (0, 1):
        train = [text[i].encode() for i in by[q][::2]]
        try:
            dictionary[q] = zstandard.train_dictionary(65536, train).as_bytes()
        except zstandard.ZstdError:
            dictionary[q] = b"".join(train)[-65536:]
    press = {q: zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d)) for q, d in dictionary.items()}
    bare = zstandard.ZstdCompressor(level=3)

    def features(t):
        b = t.encode()
        cut = [b[k : k + piece] for k in range(0, len(b), piece)] or [b""]
        g, x, own = (sum(len(c.compress(p)) for p in cut) for c in (press[1], press[0], bare))
        return (g - x) / (g + x), own / (len(b) + 20)

    data = [(features(text[i]), q) for q in (0, 1) for i in by[q][1::2]]
    # gradient descent on the same penalised likelihood, features scaled by their largest value
    top = [max(abs(f[k]) for f, _ in data) or 1.0 for k in range(2)]
    w = [0.0, 0.0, 0.0]
    for _ in range(60_000):
        grad = [1e-2 * v for v in w]
        for f, q in data:
            z = (f[0] / top[0], f[1] / top[1], 1.0)
            e = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, z, strict=True)))) - q
            grad = [g + e * v for g, v in zip(grad, z, strict=True)]
        w = [v - 0.05 * g for v, g in zip(w, grad, strict=True)]
        if max(map(abs, grad)) < 1e-7:
            break

    def score(t):
        f = features(t)
        return 1 / (1 + math.exp(-max(-30, min(30, w[0] * f[0] / top[0] + w[1] * f[1] / top[1] + w[2]))))

    return score


def test_quality_equals_plain_python(spark, tmp_path):
    rows = make()
    folder = write(spark, tmp_path, rows)
    score = plain_scores(rows, quality.PIECE_BYTES)
    got = {r["doc_id"]: r for r in quality.op5_quality(spark, folder).collect()}
    for i, t, _ in rows:
        want = score(t or "")
        assert abs(got[i]["score"] - want) < 1e-3
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.3)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
