import numpy as np
from pyspark.sql import functions as F

from glyphmill.llm import langid


def test_held_out_accuracy_and_mixtures(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.train(docs.where(~F.col("held_out")))
    assert model.langs == ["de", "en", "es", "fr"]
    out = langid.identify(docs.where("held_out"), model).collect()
    right = sum(r.lang_pred == r.lang for r in out) / len(out)
    assert right > 0.97, right
    by = {x: docs.where(F.col("held_out") & (F.col("lang") == x) & (F.col("n_chars") > 1500)).orderBy("doc_id").first().text for x in ("de", "fr")}
    mixed = spark.createDataFrame([(by["de"][:1000] + " " + by["fr"][:500],), (None,), ("",), ("12 34 !?",), ("אב",)], "text string")
    got = langid.identify(mixed, model).collect()
    assert got[0].lang_pred == "de" and 0.5 < got[0].score < 0.8 and "fr:0.3" in got[0].mixture
    assert [(r.lang_pred, r.score) for r in got[1:4]] == [("und", 0.0)] * 3
    assert got[4].lang_pred in model.langs


def test_batches_do_not_matter_and_clashing_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", F.lit("x").alias("score"), F.lit(1).alias("mixture"))
    model = langid.train(docs)
    one = {r.doc_id: (r.lang_pred, round(r.score, 4)) for r in langid.identify(docs.coalesce(1), model).collect()}
    many = {r.doc_id: (r.lang_pred, round(r.score, 4)) for r in langid.identify(docs.repartition(7), model).collect()}
    assert one == many


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([("abc", None), (None, "en")], "text string, lang string")
    model = langid.train(docs)
    assert {r.lang_pred for r in langid.identify(docs, model).collect()} == {"und"}
    assert langid.identify(docs.where("false"), model).collect() == []


def test_mixtures_as_plain_em():
    """Proportions and the chosen set of each text, against EM written out in plain Python."""
    import math

    rng = np.random.default_rng(7)
    logp, owner = [], []
    for text in range(12):
        for _ in range(int(rng.integers(1, 40))):
            row = rng.normal(-9, 0.4, 3)
            row[int(rng.integers(3)) if text % 3 == 0 else text % 3] += rng.uniform(0, 4)
            logp.append(row)
            owner.append(text)
    logp, owner = np.array(logp, np.float32), np.array(owner)

    def em(rows, pi, rounds):
        for _ in range(rounds):
            shares = [[math.exp(x) * p for x, p in zip(r, pi, strict=True)] for r in rows]
            pi = [sum(s[k] / sum(s) for s in shares) / len(rows) for k in range(3)]
        return pi, sum(math.log(sum(math.exp(x) * p for x, p in zip(r, pi, strict=True))) for r in rows)

    got = langid.mixtures(logp, owner, 13)
    for text in range(12):
        rows = [[float(x) for x in r] for r in logp[owner == text]]
        full, _ = em(rows, [1 / 3] * 3, 8)
        rank = sorted(range(3), key=lambda k: (-full[k], k))
        single = [sum(r[k] for r in rows) for k in range(3)]
        first = single.index(max(single))
        best, score = [float(k == first) for k in range(3)], max(single)
        for size in (2, 3):
            start = [(full[k] + 1e-3) * (k in rank[:size]) for k in range(3)]
            pi, found = em(rows, [x / sum(start) for x in start], 4)
            if found - score <= 2 * math.log(len(rows) + 1):
                break
            best, score = pi, found
        assert np.allclose(got[text], best, atol=2e-3), (text, got[text], best)
    assert not got[12].any() and (got.max(1) < 1).sum() > 1
