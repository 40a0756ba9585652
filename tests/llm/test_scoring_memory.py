import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from helpers import frame, prose

from foliant.llm import bigru as net
from foliant.llm.labelled import PART_BYTES, parts
from foliant.llm.quality_rank import keep_quality
from foliant.llm.toxicity import Scorer, drop_toxic


def test_scorer_holds_little_beside_the_texts():
    """4 MB of text with 100000 distinct words: the words' inputs and the windows at hand, not all words projected."""
    rng = random.Random(4)
    own = [f"{k:x}{rng.randrange(1 << 20):x}" for k in range(100_000)]
    texts = [" ".join(own[(300 * k + j) % len(own)] for j in range(600)).encode() for k in range(700)]
    model = Scorer(net.fresh(np.random.default_rng(2)), np.array([0.5, 0.5, 0, 0]))
    tracemalloc.start()
    scores = model.score(texts)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert len(scores) == len(texts) and len(model.ids) == len(own)
    assert peak < 110, peak
    assert model.score(texts[350:360]) == pytest.approx(scores[350:360], abs=1e-5)


@pytest.mark.parametrize("drop", [drop_toxic, keep_quality])
def test_a_text_goes_to_python_once(spark, drop):
    rng = random.Random(6)
    docs = frame(spark, [(k, prose(rng, 30)) for k in range(40)])
    labels = spark.createDataFrame([(k, k % 2, k % 3 % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    node = drop(docs, labels)._jdf.queryExecution().analyzed()
    while node.nodeName() != "MapInArrow":
        node = node.children().head()
    assert node.children().head().output().size() == len(docs.columns)


def test_parts_hold_every_row_in_order():
    rng = random.Random(7)
    sizes = [0, 1, None, 3 * PART_BYTES, 0, *(rng.randrange(PART_BYTES // 3) for _ in range(30)), PART_BYTES, PART_BYTES, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), pa.array([None if n is None else "x" * n for n in sizes])], ["id", "text"])
    for whole in (batch, batch.slice(2, 20), batch.slice(0, 0), batch.slice(0, 1)):
        found = [*parts(whole, 1)]
        assert [i for p in found for i in p.column(0).to_pylist()] == whole.column(0).to_pylist()
        assert [t for p in found for t in p.column(1).to_pylist()] == whole.column(1).to_pylist()
        for p in found:
            own = [len(t or "") for t in p.column(1).to_pylist()]
            assert sum(own) - max(own) <= PART_BYTES
