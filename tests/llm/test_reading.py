import random

import numpy as np
import pytest

from lodestat.llm.reading import NAMES, calibrate, features, fit_trees, reading_bands

STYLE = {
    1: lambda r: "El pan sube. " + " ".join(r.choice(["Hoy no hay sol.", "Mi mamá va al mercado.", "Un kilo cuesta 5.", "Ana come pan.", "¿Qué es eso?"]) for _ in range(25)),
    2: lambda r: " ".join(r.choice(["Las exportaciones de café crecieron 4,5% en mayo, según el boletín del instituto.", "El banco informó que la cartera aumentó por segunda vez en el año.", "El transporte desde el puerto demoró dos semanas por la lluvia."]) for _ in range(8)),
    3: lambda r: " ".join(r.choice(["La desestacionalización multiplicativa condiciona la comparabilidad intertemporal de los agregados encadenados cuando revisiones subsiguientes modifican la estructura de ponderaciones.", "La heterocedasticidad condicional antecede a la interpolación temporal de los coeficientes identificables."]) for _ in range(5)),
}


@pytest.mark.parametrize("text", ["", " ", "...", "a", "\n\n\n", "日本語。" * 200, "x" * 5000, "uno. " * 40_000, "<b>|#</b>", "½́😀"])
def test_features_are_finite(text):
    f = features(text)
    assert len(f) == len(NAMES) and np.isfinite(f).all()


def test_trees_learn_and_cuts_separate():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5))
    y = 1 + (x[:, 1] > 0).astype(float) + ((x[:, 1] > 0) & (x[:, 3] > 0))
    model = fit_trees(x[:400], y[:400])
    model.cuts = calibrate(model.predict(x[:400]), y[:400])
    assert (model.band(x[400:]) == y[400:]).mean() > 0.97


def test_held_out_accuracy_on_styles(spark):
    r = random.Random(6)
    docs = [(i, STYLE[1 + i % 3](r), f"s{i % 7}", "x") for i in range(240)] + [(900, None, "s", ""), (901, "corto", "s", ""), (902, "", None, None), (3, STYLE[1](r), "s3", "x")]
    labels = [(i, 1 + i % 3, "g") for i in range(0, 240, 2)] + [(2, None, "g"), (4, 1, "h"), (777, 2, "g")]
    bands, accuracy = reading_bands(spark.createDataFrame(docs, "doc_id long, text string, source string, band string"), spark.createDataFrame(labels, "doc_id long, band int, grader string"))
    got = {x["doc_id"]: x["band"] for x in bands.collect()}
    assert set(got) == set(range(240)) and accuracy > 0.9
    assert np.mean([got[i] == 1 + i % 3 for i in range(1, 240, 2) if i != 3]) > 0.95


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "palabra " * 100, "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, band int, grader string")
    assert [tuple(r)[:2] for r in reading_bands(docs, labels)[0].collect()] == [(1, 2)]
    assert reading_bands(docs.limit(0), labels)[0].count() == 0
