"""Pages whose boxes do not meet skip the fold, with the same rows as the fold box by box."""

import math

import numpy as np

from docquill.operators import boxes as B


def test_quiet_pages_skip_the_fold(spark):
    rng = np.random.default_rng(9)
    rows = []
    for doc in range(300):
        for page in (None, 0, 1):
            n = int(rng.integers(1, 40 if doc % 20 == 0 else 6))
            x, size = rng.uniform(0, 400 if doc % 3 else 20, (n, 2)), rng.uniform(1, 30, (n, 2))
            rows += [(doc if doc else None, page, i, [*a.tolist(), *(a + s).tolist()]) for i, (a, s) in enumerate(zip(x, size, strict=True))]
    rows += [(400, 0, 0, None), (400, 0, 1, [0.0, 0.0, 1.0]), (400, 0, 2, [0.0, 0.0, math.inf, 1.0]), (400, 0, 3, [5.0, 5.0, 6.0, 6.0]), (400, 0, 4, [9.0, 9.0, 9.0, 10.0]), (400, 0, 5, [0.0, None, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "doc_id int, page long, seq int, box array<double>")
    want, pages = set(), {}
    for d, p, s, b in rows:
        pages.setdefault((d, p), []).append((s, b))
    for (d, p), page in pages.items():
        kept = B._Kept(0.8, 1.0)
        for s, b in sorted(page, key=lambda x: x[0]):
            if b is not None and len(b) == 4 and all(v is not None and math.isfinite(v) for v in b) and b[2] > b[0] and b[3] > b[1]:
                kept.offer(s, b)
        want |= {(d, p, i, s, tuple(b)) for i, (s, b) in enumerate(kept.boxes)}
    for most in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        try:
            got = B.drop_repeated_boxes(df).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(got) == len(want) and {(r.doc_id, r.page, r.place, r.seq, tuple(r.box)) for r in got} == want
    assert B.LAGS >= 2 and "MapInArrow" in B.drop_repeated_boxes(df)._jdf.queryExecution().executedPlan().toString()
