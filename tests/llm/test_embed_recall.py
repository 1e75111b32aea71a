"""Links of a large dense label."""

import numpy as np

from leafseek.llm import embed_dedup


def test_pairs_of_a_dense_label(spark):
    rng = np.random.default_rng(6)
    n, planted = 6000, 200
    x = rng.standard_normal((n, 64))
    x = np.sqrt(0.7) * np.eye(64)[0] + np.sqrt(0.3) * x / np.linalg.norm(x, axis=1, keepdims=True)  # mean cosine 0.7
    y = x[:planted] + 0.044 * rng.standard_normal((planted, 64))
    rows = [(i, v.astype("f4").tolist(), 1) for i, v in enumerate(np.concatenate([x, y]))]
    unit = np.array([v for _, v, _ in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    true = [i for i in range(planted) if unit[i] @ unit[n + i] >= 0.93]
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    found = sum(got[i].component_id == got[n + i].component_id for i in true)
    print("planted pairs", len(true), "found", found)
    assert len(true) > 150 and found >= 0.98 * len(true)


def test_passes_follow_the_size():
    few, many, dense = (embed_dedup.passes_for(n, c, 0.93, 1024, 10) for n, c in ((1000, 0.9), (1_000_000, 0.0), (200_000, 0.7)))
    assert few == 10 and 10 < many < dense
