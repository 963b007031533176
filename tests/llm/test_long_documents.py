"""What holds for short documents holds for long ones."""

import numpy as np
import pyarrow as pa

from dqspark.llm import neardup, pii


def test_pii_labels_reach_every_repeat():
    labels = len(pii.KINDS) + 1
    model = {"unary": np.zeros((pii.N_FEATURES, labels)), "chain": np.zeros((labels, labels)), "skip": 12.0 * np.eye(labels)}
    text = "call +49 30 12345678 today" + "; or dial 030 12345678 again" * 100
    lone = "in 1999 they built 030 12345678 of 42"
    (base, every), (_, other) = pii.spans([text, lone], model)
    assert len(base) == 1 and len(every) == 101 and other == []
    assert pii.masked(text, every) == "call [PHONE] today" + "; or dial [PHONE] again" * 100


def test_sketches_of_large_disjoint_sets_differ():
    texts = [" ".join(f"{p}{i}" for i in range(20_000)) for p in "ab"]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int64()), pa.array(texts)], ["doc_id", "text"])
    for what, kind, most in (("sketch", np.uint16, 0.05), ("wide", np.uint8, 0.05)):
        (out,) = neardup.signed([batch], what)
        a, b = (np.frombuffer(x, kind) for x in out.column(3).to_pylist())
        assert (a == b).mean() < most


def test_wide_sketches_agree_as_sets_do():
    words = [f"w{i}" for i in range(8000)]
    texts = [" ".join(words[:6000]), " ".join(words[1000:7000])]  # 4,996 of 6,996 shingles are shared
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int64()), pa.array(texts)], ["doc_id", "text"])
    (out,) = neardup.signed([batch], "wide")
    a, b = (np.frombuffer(x, np.uint8) for x in out.column(3).to_pylist())
    assert abs((a == b).mean() - (1 / 256 + 255 / 256 * 4996 / 6996)) < 0.08
