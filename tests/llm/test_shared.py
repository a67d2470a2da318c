import numpy as np
import psutil
import pyarrow as pa

from tickflow.llm import jaccard
from tickflow.llm.shared import released


def test_a_task_gives_its_free_memory_back():
    """Many arrays below the size that the C library maps apart, and one that stays above them."""
    stays = []

    @released
    def run(batches):
        held = [np.ones(8_000) for _ in range(4_000)]
        stays.append(np.ones(8_000))
        for batch in batches:
            sizes.append(psutil.Process().memory_info().rss)
            yield batch
        del held

    sizes = []
    before = psutil.Process().memory_info().rss
    batch = pa.RecordBatch.from_arrays([pa.array([1])], ["a"])
    assert list(run(iter([batch]))) == [batch]
    after = psutil.Process().memory_info().rss
    assert sizes[0] - before > 200 << 20 and after - before < 60 << 20


def test_stages_release(spark, monkeypatch):
    """The functions of the near-copy stage are released ones."""
    sent = []
    frame = type(spark.range(1))
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, real=frame.mapInArrow, **k: (sent.append(f), real(self, f, *a, **k))[1])
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "a b c d e f h")], "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard.keep_one(docs).collect()) == [1, 3]
    assert len(sent) > 4 and all(hasattr(f, "__wrapped__") for f in sent)
