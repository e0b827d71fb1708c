"""What the near-duplicate join holds on disk: signatures are shuffled in rounds, and their table goes as soon as they are read."""

from collections import Counter
from fractions import Fraction
from pathlib import Path

import numpy as np

from lexquarry.llm import jaccard as J
from lexquarry.plans.storage import shared_dir


def test_rounds_give_the_same_families(spark, monkeypatch):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 500, rng.integers(3, 90))) for _ in range(120)]
    texts += [t + " more" for t in texts[:60]] + [t.replace("w7", "v7", 1) for t in texts[30:90]] + texts[:9] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    result = lambda: Counter(J.jaccard_components(docs, 5, Fraction(4, 5)).collect())
    folder = Path(shared_dir(spark).removeprefix("file://")) / "lexquarry"
    whole = result()
    assert len({r.component_id for r in whole}) < len(texts) - 60
    before = set(folder.glob("*"))
    rounds = []
    monkeypatch.setattr(J, "ROUND_BYTES", 1000)
    monkeypatch.setattr(J, "families", lambda signed, n, of=J.families: rounds.append(n) or of(signed, n))
    assert result() == whole
    left = Counter(p.name.split("-")[0] for p in set(folder.glob("*")) - before)
    assert rounds == [J.ROUNDS] and J.ROUNDS > 1 and "sets" not in left and "shared" not in left
    monkeypatch.setattr(J, "KEPT", 2)  # many agree by chance
    assert result() == whole
