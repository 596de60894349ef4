"""op9's risk against numbers, its prior against known shares."""

import numpy as np
import pytest

pytest.importorskip("quillstone.llm.registry")

from quillstone.llm import op9_quality as q  # noqa: E402


def brute(fp, fu, prior):
    loss = lambda f, y: float(np.mean([np.log(1 + np.exp(-y * x)) for x in f]))
    return prior * loss(fp, 1), loss(fu, -1) - prior * loss(fp, -1)


def test_risk_and_slopes():
    rng = np.random.default_rng(2)
    met = set()
    for _ in range(200):
        fp, fu, prior = rng.normal(rng.normal() * 3, 1, 7), rng.normal(rng.normal() * 3, 1, 11), rng.uniform(0.1, 0.9)
        positive, negative = brute(fp, fu, prior)
        risk, gp, gu = q.risk_and_slopes(fp, fu, prior)
        assert abs(risk - positive - max(0.0, negative)) < 1e-9
        met.add(negative < 0)

        def descended(fp, fu, prior=prior, back=negative < 0):
            a, b = brute(fp, fu, prior)
            return -b if back else a + b

        for f, g, k in ((fp, gp, 0), (fu, gu, 1)):
            for i in range(len(f)):
                up, down = f.copy(), f.copy()
                up[i] += 1e-5
                down[i] -= 1e-5
                ends = [descended(x, fu) if k == 0 else descended(fp, x) for x in (up, down)]
                assert abs((ends[0] - ends[1]) / 2e-5 - g[i]) < 1e-6
    assert met == {True, False}


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_class_prior(share):
    rng = np.random.default_rng(7)
    draw = lambda n, at: rng.normal(at, 1, (n, 6)).astype(np.float32)
    n = 4000
    unlabelled = np.concatenate([draw(int(n * share), 1.2), draw(n - int(n * share), -1.2)])
    assert abs(q.class_prior(draw(2000, 1.2), unlabelled) - share) < 0.08
    assert q.class_prior(draw(2, 0), unlabelled) == 0.5


def test_repeated_ids_and_nulls(spark):
    rows = [(1, "Good words stand here, and more of them.", 1)] * 50 + [(None, None, None), (2, "", 0), (3, "$$ ## !!" * 40, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    for labels in (docs.select("doc_id", "quality"), docs.select("doc_id", "quality").where("false")):
        found = q.score(docs, labels, positives=5, unlabelled=6).toPandas()
        assert len(found) == 53 and found.score.between(0, 1).all() and found[found.doc_id == 1].score.nunique() == 1
    clash = docs.selectExpr("doc_id", "text", "quality as Score", "doc_id as predicted")
    kept = q.select(clash, docs.select("doc_id", "quality"))
    assert kept.columns == clash.columns and kept.dtypes == clash.dtypes and q.select(clash.limit(0), docs.select("doc_id", "quality").limit(0)).count() == 0
