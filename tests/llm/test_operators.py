"""Each operator against brute force, and on nulls, empty texts, ties, repeated rows, clashing columns and empty tables."""

import base64
import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import ROWS
from tidepool.llm import bpe, exact_dedup, langid, lm_bloom, mixing, pu_quality, queries, simhash, syncmers, token_files, warc

SF = "/root/testdata/sf0.001"
RANKS = open(queries.RANKS, "rb").read()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def body(text):
    return text or ""


# --- 1 ------------------------------------------------------------------------------------------


def closed(words, k=syncmers.K, s=syncmers.S, key=hash):
    """Positions of the closed syncmers, from the definition."""
    out = []
    for i in range(len(words) - k + 1):
        inner = [key(tuple(words[i + j : i + j + s])) for j in range(k - s + 1)]
        out += [i] if min(inner) in (inner[0], inner[-1]) else []
    return out


def test_syncmers_follow_the_definition(spark):
    words = [f"w{i * 7919 % 83}" for i in range(300)]
    frame = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    pairs = {(a, b): spark.sql(f"SELECT xxhash64(xxhash64('{a}'), xxhash64('{b}'))").first()[0] for a, b in set(zip(words, words[1:], strict=False))}
    found = [r.position for r in syncmers.anchor_table(frame).orderBy("position").collect()]
    assert found == closed(words, key=lambda pair: pairs[pair])


def test_syncmers_are_context_free(spark):
    part = " ".join(f"q{i}" for i in range(40))
    frame = spark.createDataFrame([(1, "one two " + part), (2, part + " three")], "doc_id long, text string")
    table = syncmers.anchor_table(frame)
    shared = syncmers.matches(table.where("doc_id = 1"), table.where("doc_id = 2"))
    assert {r["shift"] for r in shared.collect()} == {-2} and shared.count() > 10


def test_fingerprints_brute_force(odd, none, docs):
    for frame, rows in ((odd.where("doc_id is not null").dropDuplicates(["doc_id"]), None), (docs, None)):
        rows = sorted(((r.doc_id, body(r.text)) for r in frame.collect()), reverse=True)
        got = {r.doc_id: r for r in syncmers.fingerprints(frame).collect()}
        assert len(got) == len(rows)
        for i, (doc, text) in enumerate(rows):
            after = rows[(i + 1) % len(rows)][1]
            m = len(text) // 3
            edited = text[: len(text) - m] + after[:m]
            assert got[doc].n_chars == len(text)
            assert got[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert 0 <= got[doc].near_edited <= 1 and 0 <= got[doc].near_next <= 1
            if edited == text:
                assert got[doc].near_edited == 1 and got[doc].edited_fingerprint == got[doc].fingerprint
    assert syncmers.fingerprints(odd).count() == len(ROWS) and syncmers.fingerprints(none).count() == 0


def test_successors_over_many_buckets(spark):
    ids = [i * i for i in range(5000)]
    frame = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, t string")
    got = {r.doc_id: r.next_t for r in syncmers.with_successor(frame, "doc_id", "t", ["t"]).collect()}
    assert got == {i: f"t{ids[n - 1]}" for n, i in enumerate(ids)}


# --- 2 ------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "u", "<p>a</p>"), (2, "v\r\nX: y", "<p>a</p>"), (3, None, None), (4, "w", ""), (None, "n", "<p>a</p>"), (5, "z", "é" * 70000), (5, "z", "é" * 70000), (-3, "m", "<p>b</p>")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))


def test_archives_round_trip(spark, pages):
    got = sorted(map(tuple, warc.archive_round_trip(pages, token_files.new_folder(spark, "w")).collect()), key=repr)
    first = {"<p>a</p>": 1, "": 3, "é" * 70000: 5, "<p>b</p>": -3}
    want = []
    for r in pages.collect():
        data = body(r.html).encode()
        own = first[body(r.html)] == r.page_id
        want.append((r.page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if own else "revisit", None if own else first[body(r.html)]))
    assert got == sorted(want, key=repr)
    assert warc.archive_round_trip(pages.limit(0), token_files.new_folder(spark, "w")).count() == 0


class Source:
    def __init__(self, data):
        self.data = data

    def read(self, size):
        out, self.data = self.data[:size], self.data[size:]
        return out


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_finds_later_records_and_logs_gaps(packed):
    made = []
    for i in range(6):
        data = bytes(np.random.default_rng(i).integers(0, 256, 400_000 if i == 2 else 300, np.uint8))
        plain = warc.record("response", str(i), "u", data, warc.payload_digest(data), len(data))
        made.append(warc.member(plain) if packed else plain)
    broken = bytearray(made[2])
    broken[len(broken) // 2] ^= 255
    junk = b"WARC/1.1 no record" + warc.MAGIC + b"\0" * 300_000
    whole = made[0] + made[1] + bytes(broken) + made[3] + junk + made[4] + made[5][:-20]
    found = list(warc.Reader(Source(whole)))
    assert [f["record_id"][-1] for kind, _, f in found if kind == "record"] == ["0", "1", "3", "4"]
    logged = [(at, f["size"]) for kind, at, f in found if kind == "gap"]
    sizes = list(map(len, made))
    assert logged == [
        (sum(sizes[:2]), sizes[2]), (sum(sizes[:4]), len(junk)), (sum(sizes[:5]) + len(junk), sizes[5] - 20),
    ]
    assert list(warc.Reader(Source(b""))) == []


@pytest.mark.parametrize("packed", [True, False])
def test_headers_have_no_bound(packed):
    made, urls = [], ["u", "data:," + "x" * 100_000, "v", "data:," + "y" * 400_000]
    for url in urls:
        plain = warc.record("response", "1", url, b"text", warc.payload_digest(b"text"), 4)
        made.append(warc.member(plain) if packed else plain)
    found = list(warc.Reader(Source(b"".join(made))))
    assert [(kind, f.get("url")) for kind, _, f in found] == [("record", u) for u in urls]
    # a version line without a header end is a gap to the end of the file
    tail = b"WARC/1.1\r\nx" * 50 + b"y" * 500_000
    kinds = [(kind, f.get("size")) for kind, _, f in warc.Reader(Source(made[1] + tail))]
    assert kinds == [("record", None), ("gap", len(tail))]


# --- 3 ------------------------------------------------------------------------------------------


def base_scores(rows, held):
    split = [body(t).encode().lower().split() + [b"\n"] for _, t in rows]
    counts = Counter(w for words, h in zip(split, held, strict=True) if not h for w in words)
    n, v = sum(counts.values()), len(counts)
    return n, [(len(ws), sum(counts[w] > 0 for w in ws), sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for ws in split]


@pytest.mark.parametrize("head", [lm_bloom.HEAD_WORDS, 3])
def test_base_scores_are_exact(docs, head):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    n, want = base_scores(rows, held)
    got = {r.doc_id: r for r in lm_bloom.score(docs, ~lm_held("doc_id"), head_words=head).collect()}
    for (doc, _), h, (size, known, base) in zip(rows, held, want, strict=True):
        r = got[doc]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, size, known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score <= 1e-9
    apart = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in apart) > sum(r.base_score for r in apart)


def lm_held(name):
    return queries.held_out(name, 5, 1)


def test_filter_never_undercounts(docs):
    texts = [r.text for r in docs.collect()]
    model, _ = lm_bloom.train(docs)
    split = [t.encode().lower().split() for t in texts]
    exact = Counter(p for words in split for p in zip([b"\n", *words], [*words, b"\n"], strict=True))
    value = lambda w: int(lm_bloom.END) if w == b"\n" else xxhash.xxh64_intdigest(w, lm_bloom.SEED)
    pairs = np.array([[value(a), value(b)] for a, b in exact], np.uint64)
    level = lm_bloom.lookup(model.table, lm_bloom.pair_hash(pairs[:, 0], pairs[:, 1]))
    true = lm_bloom.level_of(np.array(list(exact.values())))
    assert (level >= true).all() and (level > true).mean() < 0.2


def test_filter_follows_the_corpus():
    for n in (10**6, 9 * 10**7, 54 * 10**8, 10**11):
        segments, bits = lm_bloom.sizes_of(n, 2 * n)
        assert bits >= 6 * n and bits // segments <= 12 * lm_bloom.GROUP_GRAMS and 4 * n / segments <= lm_bloom.GROUP_GRAMS


def test_scores_do_not_depend_on_segments_and_chunks(docs):
    pick = ~lm_held("doc_id")
    want = {r.doc_id: r for r in lm_bloom.score(docs, pick, bits_per_token=600).collect()}
    got = {r.doc_id: r for r in lm_bloom.score(docs, pick, bits_per_token=600, group_grams=200, chunk_tokens=3000).collect()}
    assert got.keys() == want.keys()
    for doc, r in got.items():
        assert r.score == pytest.approx(want[doc].score, rel=1e-6) and r.base_score == pytest.approx(want[doc].base_score)


def test_language_model_cases(odd, none):
    got = lm_bloom.score(odd, ~lm_held("doc_id")).collect()
    assert len(got) == len(ROWS) and {r.n_tokens for r in got if r.doc_id in (1, 2, 4)} == {1}
    assert lm_bloom.score(none, ~lm_held("doc_id")).count() == 0
    assert {r.score for r in lm_bloom.score(odd, F.lit(False)).collect()} == {0.0}


# --- 4 ------------------------------------------------------------------------------------------


def bare(text):
    return body(text).encode().translate(None, b" \t\n\x0b\x0c\r")


@pytest.mark.parametrize("counters", [1, 1000])
def test_exact_groups(odd, none, counters):
    best, size = {}, Counter()
    for doc, text, *_ in ROWS:
        key = (-len(body(text)), doc is None, doc or 0, doc)
        best[bare(text)] = min(best.get(bare(text), key), key)
        size[bare(text)] += 1
    got = exact_dedup.exact_groups(odd, counters=counters).collect()
    want = sorted((str(d), str(best[bare(t)][3]), size[bare(t)], hashlib.sha256(bare(t)).hexdigest()) for d, t, *_ in ROWS)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(best)
    kept = exact_dedup.drop_copies(odd, counters=counters)
    assert kept.columns == odd.columns and Counter(bare(r.text) for r in kept.collect()) == Counter(list(best))
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0


def test_frequent_candidates_hold_every_heavy_key(spark):
    keys = [b"hot"] * 3000 + [b"warm"] * 1000 + [str(i).encode() for i in range(5000)]
    frame = spark.createDataFrame([(bytearray(k),) for k in keys], "k binary").repartition(7)
    assert {bytes(r.key) for r in exact_dedup.frequent_candidates(frame, "k", 20).collect()} >= {b"hot", b"warm"}


# --- 5 ------------------------------------------------------------------------------------------


def test_repeated_words_have_a_place_of_their_own(spark):
    frame = spark.createDataFrame([("a a a a b",), ("",)], "t string").select(mixing.word_places(F.col("t")).alias("p"))
    first, second = [r.p for r in frame.collect()]
    assert first[0] == first[1] != 0 and first[2:4] == [0, 0] and first[4] not in (0, first[0]) and second == []


def test_rates_meet_targets_like_a_dense_solver(spark):
    draw = np.random.default_rng(1)
    post = draw.dirichlet([0.4, 0.3, 0.2], 300)
    tokens = draw.integers(0, 500, 300)
    frame = spark.createDataFrame([(int(t), [float(x) for x in p]) for t, p in zip(tokens, post, strict=True)], "tokens long, post array<double>")
    targets = [30000.0, 1000.0, 6000.0]
    fitted = mixing.fit(frame, targets, 40)
    rates = np.array([r[0] for r in frame.select(mixing.rate(F.col("post"), fitted)).collect()])
    dense = np.ones(300)
    for step in fitted.steps:
        dense = np.maximum(0, dense + post @ step)
    assert rates == pytest.approx(dense) and (rates >= 0).all()
    assert (rates * tokens) @ post == pytest.approx(fitted.reached)
    assert np.abs(np.array(fitted.reached) - targets).sum() < 0.02 * sum(targets)


def test_mixing_cases(spark, odd, none):
    labels = spark.createDataFrame([(5, "clean"), (8, "clean"), (12, "low"), (None, "low"), (13, None), (7, "other")], "doc_id long, domain string")
    weights = {"clean": 0.9, "low": 0.1}
    _, _, table = mixing.soft_rates(odd, labels, weights)
    rows = table.collect()
    assert len(rows) == len(ROWS) and all(sum(r.post) == pytest.approx(1) for r in rows)
    mixed = mixing.mix(odd, labels, weights, 1.5)
    assert mixed.columns == odd.columns and 0 < mixed.count() <= 3 * len(ROWS)
    assert mixing.mix(none, labels, weights).count() == 0
    assert mixing.mix(odd, labels.limit(0), weights).columns == odd.columns


def test_long_clean_texts_are_kept(spark):
    """Thousands of words met nowhere else say nothing about a text, and emitted rows follow the fitted rates."""
    rows = [(i, f"plain {i}") for i in range(200)] + [(i, f"plain spam spam{i % 3} {i}") for i in range(200, 300)]
    rows += [(i, " ".join(f"w{i}x{j}" for j in range(20000))) for i in range(300, 310)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, "low" if 200 <= i < 300 else "clean") for i in range(300)], "doc_id long, domain string")
    weights = {"clean": 0.99, "low": 0.01}
    _, fitted, table = mixing.soft_rates(docs, labels, weights, 1.05)
    post = {r.doc_id: r.post[0] for r in table.collect()}
    clean, low = [p for i, p in post.items() if not 200 <= i < 300], [p for i, p in post.items() if 200 <= i < 300]
    assert min(clean) > 0.9 and max(clean) - min(clean) < 1e-9 and max(low) < 0.9
    rated = docs.join(table.select("doc_id", mixing.rate(F.col("post"), fitted).alias("rate")), "doc_id")
    want = {r.doc_id: r.n for r in rated.select("doc_id", mixing.copies(F.col("rate")).alias("n")).collect() if r.n}
    got = {r.doc_id: r["count"] for r in mixing.mix(docs, labels, weights, 1.05).groupBy("doc_id").count().collect()}
    assert got == want and set(range(200)) | set(range(300, 310)) <= set(got)


# --- 6 ------------------------------------------------------------------------------------------


def test_token_files_round_trip(spark, odd, none, docs):
    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    tokenizer.encode_special_tokens = True
    definition = open(queries.TOKENIZER, encoding="utf-8").read()
    for frame in (odd, docs):
        rows = sorted(((r.doc_id, body(r.text)) for r in frame.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        shards = token_files.write_shards(frame, definition, 2, token_files.new_folder(spark, "t"), length=16)
        got = sorted(map(tuple, token_files.read_documents(shards).collect()), key=lambda r: r[1])
        start, want = 0, []
        for doc, text in rows:
            ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
            want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        assert got == want
    shard = token_files.Shard(shards.first().path)
    last = shard.file.num_record_batches - 1
    assert shard.file.schema.field("ids").type == pa.list_(pa.field("item", pa.uint16(), nullable=False), 16)
    assert shard.sequence(0).tolist() == shard.ids(0, 16).tolist() and not shard.ids(0, 16).flags.owndata
    assert sum(shard.batch(i).column("mask").flatten().true_count for i in range(last + 1)) == shards.first().n_tokens
    assert token_files.read_documents(token_files.write_shards(none, definition, 2, token_files.new_folder(spark, "t"))).count() == 0


# --- 7 ------------------------------------------------------------------------------------------


def test_non_negative_risk_separates_without_negatives():
    draw = np.random.default_rng(3)
    good, bad = draw.normal(1.5, 1, (900, 4)), draw.normal(-1.5, 1, (400, 4))
    model = pu_quality.fit(good[:400], np.vstack((good[400:], bad[:200])), 500 / 700)
    g = ((bad[200:] - model.mean) * model.scale) @ model.weights + model.bias
    assert (g < 0).mean() > 0.9


def test_quality_on_held_out_rows(spark, odd, none):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    found = queries.op7_pu_quality(spark, d).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in found]) > 0.93
    model = pu_quality.train(odd, labels, F.lit(True))
    scored = pu_quality.with_score(odd, model, name="q")
    assert scored.count() == len(ROWS) and scored.where("q is null or q < 0 or q > 1").count() == 0
    assert pu_quality.with_score(odd, pu_quality.train(none, labels.limit(0), F.lit(True)), name="q").select("q").distinct().first()[0] == 0.5


# --- 8 ------------------------------------------------------------------------------------------


def test_languages_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    known = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    found = queries.op8_nearest_centroid(spark, d).join(known, "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in found]) > 0.97 and np.mean([r.rejected for r in found]) < 0.01


def test_language_cases(odd, none):
    model = langid.train(odd, F.lit(True))
    found = {r.number_: r["guess"] for r in langid.predict(odd.withColumn("number_", F.col("fp")), model, name="guess").collect()}
    for place, (_, text, *_rest) in enumerate(ROWS):
        blank = not any(map(str.isalpha, body(text)))
        assert (found[place].lang == "und" and found[place].score == 0 and found[place].rejected) == blank
    kept = langid.keep_known(odd, model)
    assert kept.columns == odd.columns and kept.where("doc_id in (1, 2, 4, 7)").count() == 0
    assert langid.keep_known(none, model).count() == 0
    assert {r.guess.lang for r in langid.predict(odd, langid.train(none, F.lit(True)), name="guess").collect()} == {"und"}


# --- 9 ------------------------------------------------------------------------------------------


def brute_components(rows, bits):
    """Components by comparing all pairs of fingerprints."""
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= bits:
                a, b = find(i), find(j)
                label[max(a, b, key=lambda k: rows[k][0])] = min(a, b, key=lambda k: rows[k][0])
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def brute_fingerprint(text):
    words = body(text).encode().lower().split()
    parts = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    values = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def test_fingerprints_and_components(docs):
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    want = brute_components(rows, 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.groups(docs).collect()}
    assert got == {doc: (f"{fp:016x}", want[doc]) for doc, fp in rows}


@pytest.mark.parametrize("block_rows", [8, 4096])
def test_links_of_dense_groups(spark, block_rows):
    draw = np.random.default_rng(5)
    fps = set()
    for base in draw.integers(0, 1 << 63, 6):
        for _ in range(80):
            fps.add(int(base) ^ sum(1 << int(b) for b in draw.choice(64, draw.integers(0, 7), replace=False)))
    rows = list(enumerate(fps))
    frame = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in rows], "node long, fp long")
    found = simhash.components(simhash.links(frame, 4, block_rows)).collect()
    assert {i: i for i, _ in rows} | {r.node: r.component for r in found} == brute_components(rows, 4)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "u long, v long")
    found = {r.node: r.component for r in simhash.components(edges).collect()}
    assert found == {i: 0 for i in range(1, 61)} | {101: 100}


def test_simhash_cases(odd, none):
    got = simhash.groups(odd).collect()
    assert len(got) == len(ROWS)
    assert {r.fingerprint for r in got if r.doc_id in (1, 2, 4)} == {"0" * 16}
    kept = simhash.drop_near_copies(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(map(str, ids)) == sorted({str(r.component_id) for r in got})
    assert simhash.groups(none).count() == 0 and simhash.drop_near_copies(none).count() == 0


def test_rows_of_one_id_are_linked_by_bits_alone(spark):
    rows = [(None, "alpha beta gamma delta epsilon zeta"), (None, "one two three four five six seven"), (7, "red green blue white black grey"),
            (7, "north south east west up down"), (9, "north south east west up down"), (None, "red green blue white black grey")]
    want = {t: brute_fingerprint(t) for _, t in rows}
    assert all((a ^ b).bit_count() > 4 for a in want.values() for b in want.values() if a != b)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.groups(frame).collect())
    label = {t: min((d for d, u in rows if u == t and d is not None), default=None) for _, t in rows}
    assert got == Counter((d, f"{want[t]:016x}", label[t]) for d, t in rows)
    kept = Counter((r.doc_id, r.text) for r in simhash.drop_near_copies(frame).collect())
    assert kept == Counter((label[t], t) for t in want)


# --- 10 -----------------------------------------------------------------------------------------


def test_bpe_like_the_library(odd, none, docs):
    own = bpe.Coder(RANKS, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    odd_texts = ["  a   b \n\n c\t d  ", "\x1c a \x1c  b", "a" * 5000, "ab" * 900 + " " * 3000 + "é" * 900, "it's we'll 123,,,!! 日本語 🎉", "\u0085   z", "\x00 nul"]
    for texts in (odd_texts, [r.text for r in docs.collect()]):
        ids = own.encode(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [library.encode_ordinary(t) for t in texts]
        assert own.decode(ids) == [t.encode() for t in texts]
    assert own.decode([None, b""]) == [b"", b""]
    with pytest.raises(ValueError):
        own.decode([np.array([60000], "<u4").tobytes()])
    got = Counter((r.doc_id, r.decoded_sha256) for r in bpe.round_trip(odd, RANKS, public_tokenizers.PATTERN).collect())
    assert got == Counter((d, hashlib.sha256(body(t).encode()).hexdigest()) for d, t, *_ in ROWS)
    assert bpe.round_trip(none, RANKS, public_tokenizers.PATTERN).count() == 0


# --- pipeline -----------------------------------------------------------------------------------


def test_pipeline_follows_its_stages(spark, docs):
    import corpus_pipeline

    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["language_id", "exact_copies", "near_copies", "mixture", "encoding"]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, SF)
        if name != "BPE encoding":
            assert now.columns == docs.columns
        if name in ("exact dedup", "SimHash near-dedup"):
            texts = {r.doc_id: r.text for r in before.collect()}
            kept = {r.doc_id for r in now.collect()}
            if name == "exact dedup":
                best = {}
                for doc, text in texts.items():
                    best[bare(text)] = min(best.get(bare(text), (0, 1 << 60)), (-len(text), doc))
                assert kept == {doc for _, doc in best.values()}
            else:
                assert kept == set(brute_components([(d, brute_fingerprint(t)) for d, t in texts.items()], 4).values())
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in now.collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
