"""The media query against a plain rewrite, and features of the format that texts seldom reach."""

import hashlib
import zlib

import numpy as np
import pytest

from tenderlake.llm import mixing, suffixdedup, toxicity, webp

SMALL = "/root/testdata/sf0.001"


def test_query_as_a_plain_rewrite(spark):
    got = {r["doc_id"]: r for r in webp.op4_media(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for i, text in docs:
        raw = (text or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        file, row = webp.store(payload), got[i]
        px = webp.decode(file)
        means = [sum(payload[k::4]) / (len(payload) // 4) for k in range(4)]
        assert (row["n_bytes"], row["payload_bytes"], row["media_bytes"], row["n_pixels"]) == (len(raw), len(payload), len(file), px.size)
        assert row["payload_sha256"] == hashlib.sha256(payload).hexdigest() and row["tail_crc32"] == zlib.crc32(payload[-64:])
        assert row["media_sha256"] == hashlib.sha256(file).hexdigest()
        assert row["feature"] == f"{px.shape[1]}x{px.shape[0]} " + " ".join(f"{m:.3f}" for m in means)


def _symbols(file, monkeypatch):
    """The file's pixels, and whether its main image has a cache and uses back-references."""
    seen = []
    plain = webp._one_group
    monkeypatch.setattr(webp, "_one_group", lambda bits, codes, n, w, cache: seen.append((cache, codes)) or plain(bits, codes, n, w, cache))
    px = webp.decode(file)
    return px, seen[-1][0]


def test_references_and_cache_stay_together(monkeypatch):
    rng = np.random.default_rng(5)
    noise = rng.integers(0, 1 << 32, 3000, dtype=np.uint32)
    often = np.repeat(rng.integers(0, 1 << 32, 40, dtype=np.uint32)[rng.integers(0, 40, 700)], 1)
    px = np.concatenate([noise, often, noise[100:109], often[:50]])  # few pixels are copies
    payload = px.astype(">u4").tobytes()
    payload = payload.ljust(-(-len(payload) // 64) * 64, b"\0")
    words = np.frombuffer(payload, ">u4").astype(np.uint32)
    out = webp._Out()
    kept = webp._parse(words)
    assert kept and sum(n for _, n, _ in kept) * 16 < len(words)
    webp._put_pixels(out, words, 16, 6)
    bits = webp._Bits(out.bytes() + b"\0" * 8)
    assert np.array_equal(webp._image(bits, 16, len(words) // 16, True), words)
    back, cache = _symbols(webp.store(payload), monkeypatch)
    assert cache == 6 and back.astype(">u4").tobytes()[: len(payload)] == payload


def test_texts_keep_their_references(spark, monkeypatch):
    """Every reference that is found is written: its length symbols have a code."""
    written = []
    fitted = webp._fitted
    monkeypatch.setattr(webp, "_fitted", lambda counts, *a: written.append(np.array(counts)) or fitted(counts, *a))
    found = 0
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(40).collect():
        raw = (r["text"] or "").encode()
        words = np.frombuffer(raw.ljust(-(-max(1, len(raw)) // 64) * 64, b"\0"), ">u4").astype(np.uint32)
        written.clear()
        webp._put_pixels(webp._Out(), words, 32, 6)
        greens = [c for c in written if len(c) > 280]
        assert sum(c[256:280].sum() for c in greens) == len(webp._parse(words))
        found += len(webp._parse(words)) > 0
    assert found


def test_several_code_groups():
    """A file by hand: four tiles of 4 by 4 pixels, each with codes of one symbol of its own."""
    out = webp._header(8, 8)
    out.put(0, 1)  # no transform
    out.put(0, 1)  # no cache
    out.put(1, 1)  # groups by tiles
    out.put(0, 3)  # of 4 by 4
    webp._put_image(out, [g << 8 | 0xFF000000 for g in range(4)], 2, False, references=False)
    for g in range(4):
        for s in (10 + g, 20 + g, 30 + g, 40 + g, 0):
            out.put(1 | 1 << 2 | s << 3, 11)
    px = webp.decode(webp._file(out.bytes()))
    want = [[(40 + g) << 24 | (20 + g) << 16 | (10 + g) << 8 | 30 + g for x in range(8) for g in [(y >> 2) * 2 + (x >> 2)]] for y in range(8)]
    assert px.tolist() == want


def test_payloads_of_several_files(spark):
    part = 4 * 16 * 16
    text = "".join(chr(97 + i * i % 23) for i in range(3 * part + 70))
    row = webp.media(spark.createDataFrame([(1, text), (2, "a")], "doc_id long, text string"), part=part).where("doc_id = 1").first()
    assert bytes(row["payload"])[: row["n_bytes"]] == text.encode() and row["feature"].startswith("16x16+16x16+16x16+16x")
    assert b"".join(x.astype(">u4").tobytes() for x in webp.decode_parts(bytes(row["media"])))[: len(text)] == text.encode()
    assert len(row["pixels"]) == sum(x.size for x in webp.decode_parts(bytes(row["media"])))


def test_clashing_columns(spark):
    rows = [(1, "a b c", "s", 9, 9.0, b"x"), (2, "d", None, 8, 8.0, b"y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, target double, kept binary")
    got = mixing.mix(docs, keep=["doc_id", "size", "target", "source", "kept"])
    assert got.columns == ["doc_id", "source", "kept", "size", "source_size", "target", "whole", "taken"]
    assert {r["doc_id"]: r["size"] for r in got.collect()} == {1: 3, 2: 1}
    cut = suffixdedup.remove_repeats(docs, carry=["source", "kept"])
    assert cut.columns == ["doc_id", "n_bytes", "kept", "removed", "source"]
    assert sorted(bytes(r["kept"]) for r in cut.collect()) == [b"a b c", b"d"]
    plain = toxicity.score(docs, np.zeros((1 << toxicity.Settings().bits) + 1, np.float32), keep=[])
    assert plain.columns == ["score", "predicted"] and [r["score"] for r in plain.collect()] == [0.5, 0.5]


@pytest.mark.parametrize("seed", range(30))
def test_viterbi_over_all_paths(seed):
    from itertools import product

    from tenderlake.llm import langid

    rng = np.random.default_rng(seed)
    e, penalty = -rng.integers(0, 12, (int(rng.integers(1, 7)), 3)).astype(float), float(rng.integers(1, 10))
    worth = lambda p: sum(e[i, x] for i, x in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:]))
    assert worth(langid.viterbi(e, penalty).tolist()) == max(map(worth, product(range(3), repeat=len(e))))


def test_suffix_query_by_brute_force(spark):
    docs = sorted((r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    seen, want = set(), {}
    for i, raw in docs:
        gone = np.zeros(len(raw) + 1, bool)
        for at in range(len(raw) - 99):
            if raw[at : at + 100] in seen:
                gone[at : at + 100] = True
            seen.add(raw[at : at + 100])
        edges = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        want[i] = (len(raw), int(gone.sum()), edges, hashlib.sha256(kept).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixdedup.op5_suffix_dedup(spark, SMALL).collect()}
    assert got == want


def test_references_and_cache_by_a_plain_loop():
    """Copies bring the slots of their pixels along; a hit on an empty slot gives zero, which enters slot zero."""
    rng = np.random.default_rng(3)
    for cache_bits in (0, 1, 4):
        for _ in range(40):
            n, w = 60, 8
            px = rng.choice(np.array([0, 1, 7, 1 << 20, 0xFFFFFFFF], np.uint32), n)
            hit = rng.random(n) < 0.4 if cache_bits else np.zeros(n, bool)
            kind = np.where(hit, 280 + rng.integers(0, 1 << cache_bits, n), 5)
            events = [(int(k), int(rng.integers(1, 30)), int(rng.integers(1, 8)) + 120) for k in np.sort(rng.choice(np.arange(10, n), 5, replace=False))]
            want, cache = [], [0] * (1 << cache_bits)

            def enter(v):
                want.append(v)
                if cache_bits:
                    cache[(webp._HASH * v & 0xFFFFFFFF) >> (32 - cache_bits)] = v

            at = 0
            for upto, length, code in [*events, (n, 0, 0)]:
                for k in range(at, upto):
                    enter(cache[kind[k] - 280] if hit[k] else int(px[k]))
                at = upto
                for _ in range(length):
                    enter(want[len(want) - (code - 120)])
            assert webp._resolved(px, kind, hit, events, 1000, w, cache_bits).tolist() == want


def test_an_image_of_one_colour_is_read_at_once(monkeypatch):
    out = webp._Out()
    webp._put_small(out, [0x12345678], 1)
    out.put(0b101, 3)
    read = []
    monkeypatch.setattr(webp, "_read_group", lambda *a: read.append(a))
    bits = webp._Bits(out.bytes())
    assert webp._image(bits, 3, 2, False).tolist() == [0x12345678] * 6 and not read and bits.read(3) == 0b101


def _counts(rng, rows, size):
    """Rows of counts of many shapes: none, one, two, few, all, and some far apart."""
    out = np.zeros((rows, size), np.int64)
    for k in range(rows):
        used = rng.choice(size, int(rng.integers(0, size + 1)) if k % 2 else k % 5, replace=False)
        out[k, used] = 1 + rng.integers(0, 1 << int(rng.integers(1, 17)), len(used)) ** (1 + k % 2) // 7
    return out


def test_codes_of_many_images_as_one_by_one():
    rng = np.random.default_rng(11)
    for size, most in ((344, 12), (256, 12), (40, 12), (19, 7)):
        counts = _counts(rng, 60, size)
        fits = webp._fitted_rows(counts, most)
        assert np.array_equal(fits, [webp._fitted(c, most) for c in counts])
        bits, lens = webp._written_rows(fits)
        for k, fit in enumerate(fits):
            assert all(np.array_equal(a, b) for a, b in zip((bits[k], lens[k]), webp._written(fit)))
        padded = np.zeros((60, 344), np.int64)
        padded[:, :size] = fits
        value, width, runs = webp._code_rows(padded, np.full(60, size))
        ends = runs.cumsum()
        for fit, begin, end in zip(fits, ends - runs, ends):
            want, got = webp._Out(), webp._Out()
            webp._put_code(want, fit)
            for v, n in zip(value[begin:end].tolist(), width[begin:end].tolist()):
                got.put(v, n)
            assert (got.value, got.n) == (want.value, want.n)


def test_many_payloads_as_one_by_one(monkeypatch):
    """The same files, whatever lies beside a payload, and no code of a short one is built alone."""
    rng = np.random.default_rng(12)
    words = [bytes(rng.integers(97, 123, int(rng.integers(1, 9)), dtype=np.uint8)) for _ in range(300)]
    text = lambda n: b" ".join(words[int(k)] for k in rng.zipf(1.3, n) % 300)
    raw = [text(int(n)) for n in rng.integers(1, 1500, 60)]
    raw += [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (64, 700, 5000, 70_000)]
    raw += [b"", b"a", b"\0" * 3000, b"abcd" * 900, raw[3] * 3, raw[5][:64], b"\xff" * 100 + raw[7], text(60_000)]
    payloads = [r.ljust(max(64, -(-len(r) // 64) * 64), b"\0") for r in raw]
    for part in (webp.PART, 4 * 16 * 16):
        files = webp.store_many(payloads, part)
        assert files == [webp.store_parts(p, part) for p in payloads] == webp.store_many(payloads[::-1], part)[::-1]
        for p, file in zip(payloads, files):
            assert b"".join(x.astype(">u4").tobytes() for x in webp.decode_parts(file))[: len(p)] == p
    alone = []
    monkeypatch.setattr(webp, "_put_code", lambda *a: alone.append(a))
    assert webp.store_many(payloads[:60]) and not alone
    assert webp.store_many([]) == []


def test_channels_of_one_code_are_looked_up_once():
    """Shared and own codes, with and without references and cache, at every split of channels."""
    rng = np.random.default_rng(13)
    for reds, blues, alphas in ((40, 40, 40), (40, 40, 3), (40, 200, 1), (1, 1, 1)):
        for copies in (0, 5):
            lanes = np.stack([rng.integers(0, n, 800, dtype=np.uint32) for n in (blues, 50, reds, alphas)], axis=1).astype(np.uint8)
            px = np.ascontiguousarray(lanes).view(np.uint32).ravel()
            for k in range(copies):
                px[100 * k + 200 : 100 * k + 260] = px[30 * k : 30 * k + 60]
            for cache_bits in (0, 6):
                out = webp._Out()
                webp._put_pixels(out, px, 16, cache_bits)
                assert np.array_equal(webp._image(webp._Bits(out.bytes() + b"\0" * 8), 16, 50, True), px)
