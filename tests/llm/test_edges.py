"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, with values."""

import hashlib
import zlib

import numpy as np
import pytest
import xxhash

SMALL = "/root/testdata/sf0.001"
LONG = "long passage of words " * 20_000


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, None), (2, "", "s"), (3, "one two  three\tfour", "s"), (3, "one two  three\tfour", "s"), (None, "x y", "t"), (4, LONG, "t")]
    return spark.createDataFrame([(i, t, None, s, 0, "clash", 1.5) for i, t, s in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, size string, score double")


def test_fingerprints_by_the_rule(spark, odd):
    from tenderlake.llm import simhash

    def rule(text):
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().replace(b"\x0b", b" ").split()]
        if not words:
            return 0
        w = min(4, len(words))
        h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + w]), 42) for i in range(len(words) - w + 1)]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = sorted((str(r["doc_id"]), r["fp"] % (1 << 64)) for r in simhash.near_duplicates(odd).collect())
    assert got == sorted((str(r["doc_id"]), rule(r["text"])) for r in odd.select("doc_id", "text").collect())


def test_media_values(spark, odd):
    from tenderlake.llm import webp

    for r in webp.media(odd).collect():
        back = bytes(r["payload"])
        assert len(back) % 64 == 0 and len(back) >= 64 and not back[r["n_bytes"] :].strip(b"\0")
        assert np.array(r["pixels"], np.int32).astype(">i4").tobytes()[: len(back)] == back
        assert webp.decode(bytes(r["media"])).astype(">u4").tobytes()[: len(back)] == back
    texts = sorted((t or "").encode() for t in (r["text"] for r in odd.collect()))
    assert sorted(bytes(r["payload"])[: r["n_bytes"]] for r in webp.media(odd).collect()) == texts


def test_stored_images_use_the_format():
    from tenderlake.llm import webp

    # A hand-built file: 2 x 1 pixels, no transform, one symbol a code: green 1, red 2, blue 3, alpha 4.
    bits, n = 0, 0
    for value, size in ((0x2F, 8), (1, 14), (0, 14), (1, 1), (0, 3), (0, 1), (0, 1), (0, 1), *((1 | 1 << 2 | s << 3, 11) for s in (1, 2, 3, 4, 0))):
        bits |= value << n
        n += size
    raw = bits.to_bytes((n + 7) // 8, "little")
    file = b"RIFF" + (len(raw) + 12).to_bytes(4, "little") + b"WEBP" + b"VP8L" + len(raw).to_bytes(4, "little") + raw + b"\0" * (len(raw) & 1)
    assert webp.decode(file).tolist() == [[0x04020103, 0x04020103]]
    text = ("The quick brown fox jumps over the lazy dog. " * 3 + "Pack my box with five dozen liquor jugs. ") * 30
    rng = np.random.default_rng(3)
    for payload in (text.encode(), bytes(rng.integers(97, 123, 64 * 90, dtype=np.uint8)), bytes(rng.integers(0, 256, 64 * 300, dtype=np.uint8)), b"ab" * 32 * 400):
        payload = payload.ljust(-(-len(payload) // 64) * 64, b"\0")
        assert webp.decode(webp.store(payload)).astype(">u4").tobytes()[: len(payload)] == payload
    with pytest.raises(ValueError):
        webp.decode(webp.store(bytes(rng.integers(0, 256, 64 * 50, dtype=np.uint8)))[:600])


def test_mixing_by_hand(spark, odd):
    from tenderlake.llm import mixing

    rows = mixing.mix(odd).collect()
    assert sorted(r["size"] for r in rows) == [0, 0, 2, 4, 4, 80_000]
    # Sources s (8 words), t (80,002) and null (0) weigh 5, 2, 1: s stops at 24, null at 0, t takes what is left.
    assert {round(r["target"], 6) for r in rows if r["size"] == 4} == {24.0} and {round(r["target"]) for r in rows if r["size"] in (2, 80_000)} == {79_986}
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd.repartition(7)).collect()))
    mixed = mixing.mixture(odd)
    assert mixed.columns == odd.columns and {r["text"] for r in mixed.where("doc_id = 3").collect()} == {"one two  three\tfour"}
    assert mixed.where("doc_id = 3").count() == 6 and mixing.mixture(odd.limit(0)).count() == 0


def test_nearest_with_repeats_ties_and_lengths(spark):
    from tenderlake.llm import ann

    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows * 4, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for q, found in got.items():
        assert len(found) == len(set(found)) == 20 and q not in found
    few = spark.createDataFrame([(0, [1.0, 0.0]), (2, [1.0, 0.0]), (1, [1.0, 0.0]), (3, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.search(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]
    assert ann.search(few.limit(0), few.limit(0)).count() == 0


def test_revisits_by_hand(spark):
    from tenderlake.llm import warc

    rows = [(1, "response", "http://WWW.a.org:80/p/?b=2&utm_x=1&a=1#f", 10, {"etag": "one", "vary": "x"}, "d1", "body 1"), (2, "response", "https://a.org/p?a=1&b=2", 20, {"etag": "two"}, "d2", "body 2"),
            (3, "revisit", "a.org/p?a=1&b=2", 15, {"etag": "W/one", "date": "now", "server": "s"}, None, None), (4, "revisit", "a.org/p?a=1&b=2", 20, {"etag": "one"}, None, None),
            (5, "revisit", "a.org/p?a=1&b=2", 21, {"etag": "one"}, None, None), (6, "revisit", None, 21, {"etag": "one"}, None, None), (7, "revisit", "b.org", 5, None, None, None),
            (8, "revisit", "a.org/p?a=1&b=2", None, {"etag": "one"}, None, None), (5, "revisit", "a.org/p?a=1&b=2", 21, {"etag": "one"}, None, None)]
    df = spark.createDataFrame(rows, "record_id long, kind string, url string, ts long, headers map<string,string>, digest string, body string")
    for records in (df, warc.read_text(warc.to_text(df))):
        got = sorted((r["record_id"], r["response_id"], r["status"]) for r in warc.resolve(records).collect())
        assert got == [(3, 1, "resolved"), (4, 1, "resolved"), (5, 2, "mismatch"), (5, 2, "mismatch"), (6, None, "no_response"), (7, None, "no_response"), (8, None, "no_response")]
        one = warc.resolve(records).where("record_id = 3").first()
        assert one["headers"] == {"etag": "W/one", "vary": "x", "date": "now"} and one["digest"] == "d1"
    assert warc.with_bodies(warc.resolve(df), df).where("record_id = 3").first()["body"] == "body 1"
    assert warc.read_text(spark.createDataFrame([(None,), ("junk",)], "record string")).count() == 0 and warc.resolve(df.limit(0)).count() == 0


def test_toxicity_of_held_out_rows(spark, odd):
    from tenderlake.llm import toxicity

    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in toxicity.op10_toxicity(spark, "/root/testdata/sf0.01").collect()]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and truth.get(r["doc_id"]) is not None]
    assert sum(p and not t for p, t in held) <= 1 and sum(p and t for p, t in held) >= 0.4 * sum(t for _, t in held)
    w = toxicity.fit(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(odd, w, keep=["doc_id"]).collect()} == {0.5}


def test_language_of_odd_texts(spark, odd):
    from tenderlake.llm import langid

    docs = spark.createDataFrame([(i, "the cat sat on the mat", "en") for i in range(20)] + [(20 + i, "der hund lief über die straße", "de") for i in range(20)] + [(50, "кошка сидит", "ru")], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    asked = spark.createDataFrame([(1, "the mat", "x"), (2, "die Straße", "x"), (3, "КОШКА", "x"), (4, None, "x"), (5, "12 !?", "x"), (6, "the cat sat on the mat " * 9 + "der hund lief über die straße " * 3, "x")], "doc_id long, text string, lang_pred string")
    got = {r["doc_id"]: r for r in langid.label(asked, model).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 7)] == ["en", "de", "ru", "und", "und", "en"]
    assert [s["lang"] for s in got[6]["spans"]] == ["en", "de"]
    assert langid.label(odd.limit(0), model, keep=["doc_id"]).count() == 0


def test_dictionary_pieces():
    from tenderlake.llm import tokenfile

    raw = bytes(range(256)) * 100
    got = tokenfile.pieces(raw, 4, 1024)
    assert len(got) == 4 and all(len(p) == 1024 for p in got) and got[0] == raw[:1024] and got[-1] == raw[-1024:]
    assert tokenfile.pieces(b"ab", 4, 1024) == [b"ab"]


def test_stages_one_by_one(spark, odd):
    import corpus_pipeline
    from tenderlake.llm import suffixdedup

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    cut = {r["doc_id"]: r["text"] for r in stages["suffix_array"](spark, docs, SMALL).collect()}
    kept = {r["doc_id"]: bytes(r["kept"]) for r in suffixdedup.remove_repeats(docs).collect()}
    assert all(len(cut[i].encode()) <= len(kept[i]) for i in kept) and cut.keys() == kept.keys()
    for name in ("simhash", "suffix_array", "mixing"):
        assert stages[name](spark, odd, SMALL).columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert stages[name](spark, odd.limit(0), SMALL).count() == 0
    got = {r["doc_id"]: r["decoded_sha256"] for r in stages["byte_bpe"](spark, odd, SMALL).collect()}
    assert got[4] == hashlib.sha256(LONG.encode()).hexdigest() and got[1] == hashlib.sha256(b"").hexdigest()
