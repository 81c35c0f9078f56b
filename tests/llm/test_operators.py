"""The training-data operators against brute force, the published libraries and round trips."""

import base64
import hashlib
import zlib

import duckdb
import numpy as np
import pytest

SMALL = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "a"), (4, "Straße it's 12 日本語 ١٢"), (5, "word " * 400), (5, "word " * 400), (None, "tail  \n x"), (7, "<|endoftext|> y")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", "s", 0, 1) for i, t in ODD],
                                 "doc_id long, text string, lang string, source string, n_chars long, size int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def corpus(spark):
    return sorted(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())


def test_bpe_as_the_library(spark, docs, empty):
    import public_tokenizers as P
    import tiktoken

    from tenderlake.llm import bpe

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode_decode(docs, path, P.PATTERN).collect()
    want = sorted((str(i), lib.encode_ordinary(t or ""), (t or "").encode()) for i, t in ODD)
    assert sorted((str(r["doc_id"]), list(r["ids"]), bytes(r["decoded"])) for r in got) == want
    assert bpe.encode_decode(empty, path, P.PATTERN).count() == 0
    rows = {r["doc_id"]: r for r in bpe.op1_byte_bpe(spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        ids = lib.encode_ordinary(r["text"])
        assert rows[r["doc_id"]]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_simhash_components(spark, docs, empty, corpus):
    from tenderlake.llm import simhash

    fps = {r["doc_id"]: r for r in simhash.op2_simhash(spark, SMALL).collect()}
    f = {i: simhash.fingerprint(t.encode()) for i, t in corpus}
    lead = {i: i for i in f}
    change = True
    while change:
        change = False
        for a in f:
            for b in f:
                if (f[a] ^ f[b]).bit_count() <= 4 and lead[b] < lead[a]:
                    lead[a], change = lead[b], True
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in fps.items()} == {i: (f"{f[i]:016x}", lead[i]) for i in f}
    assert simhash.near_duplicates(docs).count() == len(ODD) and simhash.near_duplicates(empty).count() == 0
    assert simhash.dedup(docs).count() == 6  # 1 and 2 are copies, 5 is twice there


def test_dense_buckets_lose_no_link(spark):
    from tenderlake.llm import simhash

    rng = np.random.default_rng(0)
    fps = list({int(x) ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for x in rng.integers(0, 1 << 62, 5) for _ in range(60)})
    df = spark.createDataFrame([(np.uint64(x).astype(np.int64).item(),) for x in fps], "fp long")

    def closure(pairs):
        lead = {x: x for x in fps}
        def find(x):
            while lead[x] != x:
                x = lead[x]
            return x
        for a, b in pairs:
            lead[max(find(a), find(b))] = min(find(a), find(b))
        return {x: find(x) for x in fps}

    want = closure((a, b) for a in fps for b in fps if (a ^ b).bit_count() <= 4)
    for dense in (2, 128):
        got = [(r["u"] & (2**64 - 1), r["v"] & (2**64 - 1)) for r in simhash.links(df, dense=dense).collect()]
        assert all((a ^ b).bit_count() <= 4 for a, b in got) and closure(got) == want


def test_a_half_bucket_gives_fewer_rows_than_it_has():
    import pyarrow as pa

    from tenderlake.llm import simhash

    fps = np.sort(np.array([0, *(1 << i for i in range(40))], np.uint64)).view(np.int64)  # all within two bits of each other
    batch = pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), 7)), pa.array(fps)], names=["key", "fp"])
    got = [(u, v) for b in simhash._pairs(iter([batch]), 128, 4) for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert len(got) == len(fps) - 1 and all((u ^ v).bit_count() <= 4 for u, v in got)
    met = {0}
    for _ in got:
        met |= {x for pair in got if met & set(pair) for x in pair}
    assert met == set(fps.tolist())


def _words(rng, n):
    return ["".join(map(chr, rng.integers(97, 123, 7))) for _ in range(n)]


def _similarity(a, b):
    a, b = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(a & b) / len(a | b)


def _grouped(spark, texts):
    """The leader of each text in the pipeline's stage."""
    from tenderlake.llm import simhash

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["id"]: r["lead"] for r in simhash.similar(df).collect()}


def test_isolated_near_copies_all_meet(spark):
    rng = np.random.default_rng(5)
    texts = []
    for n in range(300):
        a = _words(rng, 204)
        cut = 4 + n % 19  # shared shingles of 200: similarity from 0.98 down to 0.80
        texts += [" ".join(a), " ".join(a[:-cut] + _words(rng, cut))]
    assert min(_similarity(*texts[i : i + 2]) for i in range(0, 600, 2)) >= 0.8
    lead = _grouped(spark, texts)
    assert sum(lead[i + 1] == i for i in range(0, 600, 2)) == 300 and len(set(lead.values())) == 300


def test_chains_of_near_copies_stay_whole(spark):
    rng = np.random.default_rng(6)
    texts = []
    for _ in range(100):  # neighbours have a similarity of 0.81, the ends of a chain one of 0.65
        a, left, right = _words(rng, 204), _words(rng, 21), _words(rng, 21)
        b = a[:-21] + right
        texts += [" ".join(a), " ".join(b), " ".join(left + b[21:])]
    assert _similarity(*texts[:2]) >= 0.8 and _similarity(*texts[1:3]) >= 0.8 and _similarity(texts[0], texts[2]) < 0.8
    lead = _grouped(spark, texts)
    assert all(lead[i] == i - i % 3 for i in range(300))


def test_texts_below_the_similarity_stay_apart(spark, corpus):
    rng = np.random.default_rng(7)
    texts = []
    for n in range(200):
        a = _words(rng, 204)
        texts += [" ".join(a), " ".join(a[: -(23 + n % 8)] + _words(rng, 23 + n % 8))]
    near = [_similarity(*texts[i : i + 2]) for i in range(0, 400, 2)]
    assert 0.7 < min(near) and max(near) < 0.8
    assert _grouped(spark, texts) == {i: i for i in range(400)}


def test_near_copies_as_brute_force(spark, corpus):
    from tenderlake.llm import simhash

    texts = [t or "" for _, t in corpus]
    sets = []
    for t in texts:
        w = t.encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    lead = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both * 5 >= 4 * (len(sets[a]) + len(sets[b]) - both):
                lead = [min(lead[a], lead[b]) if x in (lead[a], lead[b]) else x for x in lead]
    assert _grouped(spark, texts) == dict(enumerate(lead))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.dedup(df).collect()} == set(lead)


def test_revisits_as_sql(spark):
    from tenderlake.llm import warc

    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{SMALL}/pages.parquet'")
    q = con.sql(warc.OP3_SQL)
    df = warc.op3_revisits(spark, SMALL).select(*q.columns)
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, q.fetchall()))
    few = warc.resolve(warc.page_records(spark.read.parquet(f"{SMALL}/pages.parquet")), bucket=3)
    wide = warc.resolve(warc.page_records(spark.read.parquet(f"{SMALL}/pages.parquet")), bucket=1 << 30)
    assert sorted(map(str, few.collect())) == sorted(map(str, wide.collect()))


@pytest.mark.parametrize("options", [{}, {"modes": 0}, {"modes": 5}, {"cross": 0xFF12F0A3}, {"green": True}, {"cache_bits": 4},
                                     {"modes": 11, "cross": 0x35A0, "green": True, "cache_bits": 10}, {"palette": True}])
def test_webp_round_trip(options):
    from tenderlake.llm import webp

    rng = np.random.default_rng(1)
    for shape in ((1, 1), (3, 5), (33, 40)):
        px = (rng.integers(0, 3, shape) * 0x01020304 + 0x10203040).astype(np.uint32)
        assert np.array_equal(webp.decode(webp.encode(px, **options)), px)
        if "palette" not in options:
            px = rng.integers(0, 1 << 32, shape, dtype=np.uint32)
            assert np.array_equal(webp.decode(webp.encode(px, **options)), px)
    with pytest.raises(ValueError):
        webp.decode(webp.encode(px, **options)[:60])


def test_media_columns(spark, docs, empty):
    from tenderlake.llm import webp

    for r in webp.media(docs).collect():
        assert len(r["payload"]) % 64 == 0 and not bytes(r["payload"])[r["n_bytes"] :].strip(b"\0")
    got = sorted(bytes(r["payload"])[: r["n_bytes"]] for r in webp.media(docs).collect())
    assert got == sorted((t or "").encode() for _, t in ODD) and webp.media(empty).count() == 0


def test_suffix_dedup(spark, docs, empty, corpus):
    from tenderlake.llm import suffixdedup

    got = {r["doc_id"]: bytes(r["kept"]) for r in suffixdedup.remove_repeats(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()}
    seen = set()
    for i, t in corpus:
        x = t.encode()
        gone = bytearray(len(x))
        for s in range(len(x) - 99):
            if (w := x[s : s + 100]) in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        assert got[i] == bytes(c for c, g in zip(x, gone) if not g)
    assert suffixdedup.remove_repeats(empty).count() == 0 and suffixdedup.remove_repeats(docs).count() == len(ODD)


def test_merge_is_a_sort():
    from tenderlake.llm import suffixdedup

    rng = np.random.default_rng(2)
    runs = [sorted(bytes(rng.integers(97, 99, rng.integers(1, 9)).astype(np.uint8)) for _ in range(n)) for n in (5, 0, 40, 17)]
    run, at, lcp = suffixdedup.merge_runs([suffixdedup.front_code(r) for r in runs])
    out = [runs[r][i] for r, i in zip(run, at)]
    assert out == sorted(x for r in runs for x in r)
    assert all(n == suffixdedup._shared(a, b, 0) for a, b, n in zip(out, out[1:], lcp[1:]))


def test_mixing(spark, docs, empty):
    from tenderlake.llm import mixing

    rows = mixing.op6_mixing(spark, SMALL).collect()
    src = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    names = sorted(set(src.values()))
    size = {n: sum(r["size"] for r in rows if src[r["doc_id"]] == n) for n in names}
    target, free, left = {}, dict(zip(names, [5, 2, 1] * len(names))), float(sum(size.values()))
    while True:
        share = {n: left * w / sum(free.values()) for n, w in free.items()}
        over = [n for n in free if share[n] > 3 * size[n]]
        if not over:
            target |= share
            break
        for n in over:
            target[n] = 3.0 * size[n]
            left -= target[n]
            del free[n]
    for n in names:
        own = [r for r in rows if src[r["doc_id"]] == n]
        assert all(abs(r["target"] - target[n]) < 1e-6 * (1 + target[n]) and r["taken"] <= 3 * r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - target[n]) <= 1
    assert mixing.mix(empty).count() == 0 and mixing.mix(docs).count() == len(ODD)
    assert mixing.mixture(docs).columns == docs.columns


def test_language(spark, docs, empty):
    from tenderlake.llm import langid

    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    held = [r for r in langid.op7_language(spark, SMALL).collect() if r["held_out"] and truth[r["doc_id"]]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    model = langid.fit(empty)
    assert {r["lang_pred"] for r in langid.label(docs, model, keep=["doc_id"]).collect()} == {"und"}
    assert langid.viterbi(np.array([[0, -5.0]] * 9 + [[-5.0, 0]] * 9), 12.0).tolist() == [0] * 9 + [1] * 9


def test_viterbi_without_the_best_single_label():
    from tenderlake.llm import langid

    assert langid.viterbi(np.array([[0, -8.0, -3.5]] * 3 + [[-8.0, 0, -3.5]] * 3), 12.0).tolist() == [0] * 3 + [1] * 3


def test_token_files(spark, docs, empty):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from tenderlake.llm import tokenfile

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    at, rows = 0, {r["doc_id"]: r for r in tokenfile.op8_token_file(spark, SMALL).collect()}
    for r in sorted(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()):
        ids = np.array([*lib.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        got = rows[r["doc_id"]]
        assert (got["start"], got["n_tokens"], got["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    shard = tokenfile.Shard(tokenfile.write_shard([b"\1\0\2\0", b""], 2, b""), b"")
    assert [shard.ids(i).tolist() for i in range(2)] == [[1, 2], []]
    with pytest.raises(ValueError):
        tokenfile.Shard(tokenfile.write_shard([], 2, b""), b"other")


def test_token_files_of_added_tokens(docs):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from tenderlake.llm import tokenfile

    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = [(str(r["id"]), r["n_tokens"], r["ids_crc32"]) for r in tokenfile.read(*tokenfile.write(docs, path, P.PATTERN)).collect()]
    want = [(str(i), np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")) for i, t in ODD]
    assert sorted(got) == sorted((i, len(x), zlib.crc32(x.tobytes())) for i, x in want)


def test_nearest(spark):
    from tenderlake.llm import ann

    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    x, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    found = ann.op9_nearest(spark, SMALL).collect()
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -9
        want = set(ids[np.lexsort((ids, -score))[:20]].tolist())
        got = [r["vec_id"] for r in found if r["query_id"] == ids[q]]
        assert len(got) == len(set(got)) == 20
        hits, total = hits + len(want & set(got)), total + 20
    assert hits >= 0.9 * total
    odd = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.search(odd, odd.where("vec_id = 0")).collect()] == [(0, 1, 1, 1.0)]


def test_toxicity(spark, docs, empty):
    from tenderlake.llm import toxicity

    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    texts = spark.createDataFrame([(i, f"plain words {i} and {'scum' if i % 2 else 'bread'}") for i in range(200)], "doc_id long, text string")
    w = toxicity.fit(texts, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(texts, w).collect()}
    assert min(got[i] for i in got if i % 2) > max(got[i] for i in got if not i % 2)
    assert toxicity.score(empty, w).count() == 0 and toxicity.score(docs, w, keep=["doc_id"]).count() == len(ODD)


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SMALL)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and rows.count() > 0
