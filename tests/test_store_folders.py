"""The store's folders follow its appends, not the pieces of positions that these touch."""

import os

from tidepool.operators import coverage
from tidepool.operators.store import CoverageStore

FRAGMENTS = "chrom string, start long, len long"


def test_an_append_over_many_pieces_is_one_folder(spark, tmp_path):
    store = CoverageStore(str(tmp_path / "s"), 1000)
    parts = [[("x", 10_000 * i + j, 700) for i in range(40)] for j in (0, 500)]
    for number, part in enumerate(parts):
        assert store.append(spark.createDataFrame(part, FRAGMENTS), number) == 40 * (1 + number)
    assert sorted(d for d in os.listdir(store.path) if d.startswith("batch=")) == ["batch=0", "batch=1"]
    assert sum(len(dirs) for _, dirs, _ in os.walk(store.path)) == 2
    want = coverage.profile(coverage.events(spark.createDataFrame([*parts[0], *parts[1]], FRAGMENTS)))
    assert sorted(map(repr, store.profile(spark).collect())) == sorted(map(repr, want.collect()))
