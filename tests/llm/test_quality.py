"""The quality classifier: plain rewrites of features, sums and training, held-out accuracy, odd rows."""

import zlib
from dataclasses import replace

import numpy as np
import pytest

DATA = "/root/testdata/sf0.01"
MASK = (1 << 64) - 1


def row(key, bits):
    key = ((key ^ key >> 31) * 0x9E3779B97F4A7C15) & MASK
    return (((key ^ key >> 29) * 0x9E3779B97F4A7C15) & MASK) >> (64 - bits)


def plain_rows(text, s):
    """The rows of all features of a text, repeats included, ascending."""
    words, out = (text or b"").split(), []
    for w in words:
        out.append(row(zlib.crc32(w) | 1 << 62, s.bits))
        marked = b"<" + w + b">"
        for n in s.grams:
            out += [row(int.from_bytes(marked[i : i + n], "little") | n << 56, s.bits) for i in range(len(marked) - n + 1)]
    for a, b in zip(words, words[1:]):
        out.append(row(1 << 61 if a == b else zlib.crc32(a) << 29 & MASK ^ zlib.crc32(b) | 1 << 63, s.bits))
    return sorted(out)


TEXTS = [b"", None, b"one", "Straße zwei\tdrei\n drei  drei ende".encode(), b"a b c d e f g h i j k l m n " * 9, b"x" * 300]


@pytest.mark.parametrize("chunk", [1 << 20, 3])
def test_sums_and_bags_as_the_rules_say(chunk):
    from tenderlake.llm import quality

    s = quality.Settings(bits=10, chunk_words=chunk)
    told, bias = np.random.default_rng(0).normal(size=(1 << s.bits, 2)), np.array([0.25, -0.5])
    got = quality.logits(TEXTS, told, bias, s)
    for text, sums in zip(TEXTS, got):
        rows = plain_rows(text, s)
        assert np.allclose(sums, (told[rows].mean(axis=0) if rows else 0) + bias)
        kept, share = quality.bag(text, s)
        assert list(kept) == sorted(set(rows)) and np.allclose(share, [rows.count(r) / len(rows) for r in sorted(set(rows))])


def test_training_as_scalar_steps():
    from tenderlake.llm import quality

    s = quality.Settings(bits=6, size=3, epochs=3)
    rng = np.random.default_rng(1)
    data = [(int(rng.integers(2)), np.sort(rng.choice(64, 5, replace=False)).astype(np.uint32), np.full(5, 0.2, np.float32)) for _ in range(20)]
    told, bias = quality.train(data, 2, s)
    rng = np.random.default_rng(s.seed)
    e, w, b, done = rng.uniform(-1 / 3, 1 / 3, (64, 3)).astype(np.float32).tolist(), [[0.0] * 3 for _ in range(2)], [0.0, 0.0], 0
    for _ in range(3):
        for i in rng.permutation(20):
            y, rows, share = data[i]
            rate, done = 0.6 * (1 - done / 60), done + 1
            hidden = [sum(float(x) * e[r][k] for r, x in zip(rows, share)) for k in range(3)]
            raw = [np.exp(sum(w[c][k] * hidden[k] for k in range(3)) + b[c]) for c in range(2)]
            g = [raw[c] / sum(raw) - (c == y) for c in range(2)]
            back = [sum(g[c] * w[c][k] for c in range(2)) for k in range(3)]
            w = [[w[c][k] - rate * g[c] * hidden[k] for k in range(3)] for c in range(2)]
            b = [b[c] - 0.1 * rate * g[c] for c in range(2)]
            for r, x in zip(rows, share):
                e[r] = [e[r][k] - rate * min(float(x) * 64, 1) * back[k] for k in range(3)]
    assert np.allclose(told, [[sum(e[r][k] * w[c][k] for k in range(3)) for c in range(2)] for r in range(64)], atol=1e-4)
    assert np.allclose(bias, b, atol=1e-4)


def test_held_out_accuracy(spark):
    from tenderlake.llm import quality

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r["quality"] is not None}
    rows = quality.op12_quality(spark, DATA).collect()
    assert len(rows) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    known = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    good = [r["predicted"] for r in known if labels[r["doc_id"]] == 1]
    poor = [r["predicted"] for r in known if labels[r["doc_id"]] == 0]
    assert sum(good) >= 0.97 * len(good) and sum(poor) <= 0.1 * len(poor)


def test_odd_rows_and_empty_tables(spark):
    """Null, empty, long and repeated texts, a null id, clashing columns, no labels, no rows."""
    from tenderlake.llm import quality

    s = replace(quality.Settings(), sample=100)
    docs = spark.createDataFrame([(i, None if t is None else t.decode(), "clash", 1) for i, t in enumerate(TEXTS)] + [(None, "one", "c", 2), (2, "one", "c", 2)],
                                 "doc_id long, text string, score string, _y int")
    labels = spark.createDataFrame([(2, 1), (2, 0), (3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels, s)
    out = quality.score(docs, model, s)
    assert out.columns == ["doc_id", "text", "_y", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == 8 and len({r["score"] for r in rows if r["text"] == "one"}) == 1
    assert len({r["score"] for r in rows if not r["text"]}) == 1
    assert quality.score(docs, quality.fit(docs, labels.limit(0), s), s).where("score <> 0.5").count() == 0
    assert quality.score(docs.limit(0), model, s, keep=[]).columns == ["score", "predicted"]
    assert quality.score(docs.limit(0), model, s).count() == 0
    assert quality.score(docs, model, s, keep=[]).count() == 8


def test_samples_of_long_texts_are_spread():
    from tenderlake.llm import quality

    s = quality.Settings(sample_bytes=40, sample_pieces=4)
    text = b"".join(bytes([65 + i]) * 100 for i in range(10))
    got = quality._sampled(text, s)
    assert len(got) == 43 and got.startswith(b"A") and got.endswith(b"J") and len(set(got)) > 3
