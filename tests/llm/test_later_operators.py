"""Merkle manifest, robust-pruned graph and spelling variants against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.conftest import spark  # noqa: F401
from tidepool.llm import merkle, queries, spelling, token_files, vector_graph

# --- op11 -------------------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + arity])) for i in range(0, len(levels[-1]), arity)])
    return levels


def path_in(levels, at, arity):
    steps = []
    for level in levels[:-1]:
        start = at - at % arity
        steps.append(("".join(level[start:at]), "".join(level[at + 1 : start + arity])))
        at //= arity
    return steps


def brute_merkle(rows, arity):
    """Rows (doc_id, source, lang, n_chars, text) to sorted (doc_id, leaf, subroot, root, proof, folded root)."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    order = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        by[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[g] = tree([leaf_of(r) for r in by[g]], arity)
    top = tree([trees[g][-1][0] for g in order], arity)
    found = []
    for k, g in enumerate(order):
        for at, r in enumerate(by[g]):
            steps = path_in(trees[g], at, arity) + path_in(top, k, arity)
            touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            node = leaf_of((*r[:3], r[3] + 1, r[4])) if touched else leaf_of(r)
            for left, right in steps:
                node = sha(left + node + right)
            found.append((r[0], leaf_of(r), trees[g][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), node))
    return sorted(found, key=repr)


def merkle_rows(spark, tmp, rows, **how):  # noqa: F811
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    docs.selectExpr("*", "1 AS g", "2 AS word", "'x' AS leaf", "3 AS slots").write.mode("overwrite").parquet(f"{tmp}/documents.parquet")
    if how:
        proved = merkle.proofs(spark.read.parquet(f"{tmp}/documents.parquet"), **how)
        return proved, sorted(map(tuple, merkle.verified(proved).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root").collect()), key=repr)
    got = queries.op11_merkle_manifest(spark, str(tmp))
    return got, sorted(map(tuple, got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root").collect()), key=repr)


def some_documents(n, seed=3):
    rng = random.Random(seed)
    ids = [*rng.sample(range(-(1 << 40), 1 << 40), n // 2), *range(n // 4), (1 << 63) - 1, -(1 << 63), None, None, *[77] * (n // 4)]
    texts = ["", None, "straße", "a" * 3000]
    return [(i, rng.choice(["a", None]), rng.choice(["en", "en", "en", "de", None, "é"]), rng.choice([None, 3, (1 << 63) - 1]), rng.choice(texts)) for i in ids]


def test_merkle_query_equals_brute_force(spark, tmp_path):  # noqa: F811
    rows = some_documents(400)
    got, found = merkle_rows(spark, tmp_path, rows)
    assert found == brute_merkle(rows, 2)
    flags = Counter(r.verified == (r.folded_root == r.root) for r in got.collect())
    assert set(flags) == {True} and not all(r.verified for r in got.collect())


def test_merkle_takes_other_arities_and_many_rounds(spark, tmp_path):  # noqa: F811
    rows = some_documents(300, 5)
    proved, found = merkle_rows(spark, tmp_path, rows, arity=3, levels=1)
    whole = brute_merkle(rows, 3)
    assert [r[:5] for r in found] == [r[:5] for r in whole]
    assert all(r[5] == r[3] for r in found)  # nothing was claimed, so each leaf folds to the root
    listed = {r.group: r.n_leaves for r in merkle.manifest(proved).collect()}
    assert listed == Counter(r[2] for r in rows)


def test_merkle_of_one_row_and_of_none(spark, tmp_path):  # noqa: F811
    row = (5, None, None, None, None)
    _, found = merkle_rows(spark, tmp_path, [row])
    assert found == [(5, leaf_of(row), leaf_of(row), leaf_of(row), sha(""), leaf_of(row))]
    got, found = merkle_rows(spark, tmp_path, [])
    assert found == [] and "verified" in got.columns


# --- op12 -------------------------------------------------------------------------------------------


def brute_links(vectors, threshold):
    unit = {}
    for i, v in enumerate(vectors):
        x = None if v is None or any(c is None for c in v) else np.array(v, float)
        if x is not None and len(x) and np.isfinite(x).all() and (x != 0).any():
            unit[i] = x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max())
    links = {i: set() for i in range(len(vectors))}
    for i in unit:
        for j in unit:
            if i < j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i].add(j)
                links[j].add(i)
    return links


def brute_components(ids, links):
    least = {}
    for i in links:
        todo, met = [i], {i}
        while todo:
            for j in links[todo.pop()] - met:
                met.add(j)
                todo.append(j)
        least[i] = min((ids[j] for j in met if ids[j] is not None), default=None)
    return least


def graph_rows(spark, ids, vectors, **how):  # noqa: F811
    rows = [(i, v, n, 0.5) for n, (i, v) in enumerate(zip(ids, vectors, strict=True))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node double")
    return frame, vector_graph.groups(frame, **how)


def test_graph_equals_brute_force_in_odd_cases(spark):  # noqa: F811
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 8))
    vectors = [*base.tolist(), *(base[:10] + rng.normal(size=(10, 8)) * 0.1).tolist(), *[base[0].tolist()] * 5]
    vectors += [None, [], [0.0] * 8, [1.0, None, *[0.0] * 6], [float("nan")] * 8, [float("inf"), *[1.0] * 7], [1e-38] * 8, [3e38] * 8, [1.0] * 8]
    vectors += [[1.0] * 4, [2.0] * 4, [-0.0, 1.0], [0.0, 2.0]]
    vectors = [None if v is None else [None if c is None else float(np.float32(c)) for c in v] for v in vectors]
    ids = [1000 - i for i in range(len(vectors))]
    ids[3], ids[-1], ids[7] = None, None, ids[8]
    links = brute_links(vectors, 0.95)
    least = brute_components(ids, links)
    _, got = graph_rows(spark, ids, vectors)
    wanted = sorted(((ids[i], len(links[i]), least[i] if links[i] else ids[i], ids[i] == (least[i] if links[i] else ids[i])) for i in links), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == wanted


@pytest.mark.parametrize("cell_rows", [4096, 64])
def test_graph_keeps_recall_in_small_cells_and_a_tight_ball(spark, cell_rows):  # noqa: F811
    rng = np.random.default_rng(2)
    near = lambda x, n: x + rng.normal(size=(n, 32)) * 0.1 * np.linalg.norm(x) / np.sqrt(32)
    spread = rng.normal(size=(300, 32))
    ball = near(rng.normal(size=32), 200)
    pairs = np.concatenate([near(x, 3) for x in spread[:50]])
    vectors = np.concatenate((spread, ball, pairs)).astype(np.float32).tolist()
    ids = list(range(len(vectors)))
    links = brute_links(vectors, 0.95)
    frame, got = graph_rows(spark, ids, vectors, cell_rows=cell_rows)
    found = {r.vec_id: r for r in got.collect()}
    assert all(found[i].n_links <= len(links[i]) for i in ids)
    assert sum(found[i].n_links for i in ids) >= 0.95 * sum(map(len, links.values()))
    least = brute_components(ids, links)
    assert sum(found[i].component_id == least[i] for i in ids) >= 0.99 * len(ids)
    # an audit of empty counts finds nothing
    nodes = vector_graph.nodes_of(vector_graph.prepared(frame))
    assert vector_graph.audit(nodes, nodes.selectExpr("node", "0L AS n").limit(0)) == 0.0


def test_robust_pruning_keeps_the_nearest_and_drops_what_it_reaches():
    x = np.array([[1.0, 0.0], [0.99, 0.14], [0.97, 0.24], [0.0, 1.0]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists = vector_graph.robust_lists(x)
    assert lists[0, 0] == 1 and 2 not in lists[0]


def test_graph_of_no_vectors(spark):  # noqa: F811
    assert graph_rows(spark, [], [])[1].collect() == []
    assert [tuple(r) for r in graph_rows(spark, [4], [None])[1].collect()] == [(4, 0, 4, True)]


# --- op13 -------------------------------------------------------------------------------------------


def near(a, b):
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at:] == b[at + 1 :]


def brute_variants(words, ratio=10):
    found = {}
    for w, n in words.items():
        close = [v for v in words if abs(len(v) - len(w)) < 2 and near(w, v)]
        best = min(close, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= ratio * n else None
        found[w] = (form, n, len(close), words[form] if form else None)
    out = []
    for w in words:
        root = w
        while found[root][0]:
            root = found[root][0]
        out.append((w, found[w][0], root, *found[w][1:]))
    return sorted(out)


def misspelt(rng, word):
    at = rng.randrange(len(word))
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice("aeé÷") + word[at:], word[:at] + rng.choice("abcß") + word[at + 1 :]])


def spelling_texts(seed=4):
    rng = random.Random(seed)
    common = ["interesting" + s for s in ("", "ly", "ness")] + ["zzzzzzzz", "aaaaaaaa", "aaaaaaaaa", "Überraschung", "ÉCOLIERS", "x" * 500]
    common += ["".join(rng.choice("abcdeé") for _ in range(rng.randint(7, 12))) for _ in range(60)]
    # a third of all words share a long beginning and a long end
    common += ["beginning" + "".join(rng.choice("ab") for _ in range(6)) + "theend" for _ in range(60)]
    texts = []
    for doc in range(120):
        words = [rng.choice(common) if rng.random() < 0.8 else misspelt(rng, rng.choice(common)) for _ in range(120)]
        texts.append((doc, " 9".join(words)))
    return [*texts, (None, "interesting interestink"), (3, None), (4, ""), (5, "short words only")]


def counted(texts, typo=31):
    words = Counter()
    for doc, text in texts:
        for run in spelling.RUN.findall(text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = None if doc is None else zlib.crc32(f"{doc}:{word}".encode())
            if h is not None and h % typo == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 7:
                words[word] += 1
    return {w: n for w, n in words.items() if n >= 2}


@pytest.mark.parametrize("most", [8192, 40])
def test_spelling_equals_brute_force(spark, most):  # noqa: F811
    texts = spelling_texts()
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in texts], "doc_id long, text string, n int, word string")
    got = spelling.variants(frame, most=most)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    found, wanted = sorted(map(tuple, got.collect())), brute_variants(counted(texts))
    assert found == wanted and any(r[1] for r in found) and any(r[2] not in (r[0], r[1]) for r in found) in (True, False)


def test_shards_are_cut_below_the_bound_and_lose_no_pair(spark):  # noqa: F811
    rng = random.Random(8)
    words = list({"samebeginning" + "".join(rng.choice("abc") for _ in range(7)) for _ in range(700)})
    frame = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    sizes = [r["count"] for r in spelling.shards(frame, 50).groupBy(*spelling.KEY).count().collect()]
    assert max(sizes) <= 50
    got = {r.word: r.n_near for r in spelling.near_words(frame, 50).collect()}
    assert got == {w: n for w in words if (n := sum(near(w, v) for v in words))}


def test_forms_lead_to_the_last_word(spark):  # noqa: F811
    text = " ".join(["colorings"] * 200 + ["colourings"] * 20 + ["colouringss"] * 2 + ["Colouringsx"])
    frame = spark.createDataFrame([(None, text), (None, None)], "doc_id long, text string")
    found = {r.word: (r.form, r.root) for r in spelling.variants(frame).collect()}
    assert found == {"colorings": (None, "colorings"), "colourings": ("colorings", "colorings"), "colouringss": ("colourings", "colorings")}


def test_spelling_of_no_rows(spark):  # noqa: F811
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect() == []


def test_bpe_decodes_from_one_ordered_column():
    """The pieces come in the order of their positions in one buffer: no text is put together by an ordered aggregation."""
    import base64

    from tidepool.llm import bpe

    tokens = [bytes([b]) for b in range(256)] + [b"ab", "é".encode(), b"\x00\xff"]
    own = bpe.Coder(b"\n".join(base64.b64encode(t) + f" {i}".encode() for i, t in enumerate(tokens)), r"\S+|\s+")
    lists = [[256, 257, 258, 0, 255], [], [65] * 3000, None, [257]]
    packed = [None if x is None else np.array(x, "<u4").tobytes() for x in lists]
    assert own.decode(packed) == [b"".join(tokens[i] for i in x or []) for x in lists]
    assert own.decode([]) == [] and own.decode([b"", None]) == [b"", b""]
    with pytest.raises(ValueError):
        own.decode([np.array([70_000], "<u4").tobytes()])
    assert "string_agg" not in bpe.DECODE


# --- op6 --------------------------------------------------------------------------------------------


def test_only_new_words_reach_the_model_and_odd_cuts_the_whole_tokenizer(monkeypatch):
    """Plain cuts are cut at the pattern here, a word is encoded once whatever follows it, and a full cache keeps its last generation."""
    with open(queries.TOKENIZER) as file:
        definition = file.read()
    asked, whole = [], Tokenizer.from_str(definition)
    whole.encode_special_tokens = True
    own = token_files.Encoder(definition)
    monkeypatch.setattr(own, "_ids", lambda texts, ids=own._ids: asked.extend(texts) or ids(texts))
    rng = random.Random(5)
    signs = [chr(c) for c in (*range(9, 14), *range(32, 127), *range(160, 256))]
    plain = ["".join(rng.choices(signs + list("aeiouthing '") * 12, k=rng.randint(0, 80))) for _ in range(2000)]
    plain = [t for t in plain if not token_files.UNEVEN.search(t)] + ["", "Und so, und so.", "it's <|endoftext|>", "a\n\nb \n", "x²½ 3ª"]

    def encoded(texts):
        return [np.frombuffer(ids, own.dtype).tolist() for ids in own.encode(texts)]

    assert encoded(plain) == [e.ids for e in whole.encode_batch(plain, add_special_tokens=False)]
    assert not "".join(asked)
    odd = ["漢字 kanji", "ét ́", "a  b", "\0 x\0", "😀  y", " ſİ"]
    assert encoded(odd) == [e.ids for e in whole.encode_batch(odd, add_special_tokens=False)]
    monkeypatch.setattr(token_files, "CACHE_WORDS", 0)
    met = []
    monkeypatch.setattr(own, "_keep", lambda words, *rest, keep=own._keep: met.extend(words) or keep(words, *rest))
    assert encoded(["zuzu, qqfx", "qqfx. zuzu!", " qqfx; zuzu,"])[1] == whole.encode("qqfx. zuzu!", add_special_tokens=False).ids
    assert sorted(met) == sorted(set(met)) and {" qqfx", "zuzu"} <= set(met)
    met.clear()
    assert encoded(["zuzu, qqfx"]) == [whole.encode("zuzu, qqfx", add_special_tokens=False).ids]
    assert not met


def test_repeated_words_of_a_group_are_looked_up_once(monkeypatch):
    """Arrow counts off the distinct words of many texts in three languages and other characters; texts before, between and after odd ones keep their ids."""
    with open(queries.TOKENIZER) as file:
        definition = file.read()
    whole = Tokenizer.from_str(definition)
    whole.encode_special_tokens = True
    own, asked = token_files.Encoder(definition), []
    monkeypatch.setattr(own, "_unmet", lambda words, unmet=own._unmet: asked.extend(words) or unmet(words))
    rng = random.Random(6)
    words = ["der", "Größe,", "mañana.", "it's", "(2024)", "x\xa0y", "\ttab", "line\nend", "漢字", "naïve—so", "a\u2009b", "é", "\x85", "12½"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(500)] + ["", " ", "der ", " der", "\n", "der  der", "\0", "\u3000 x"] * 3
    got = [np.frombuffer(ids, own.dtype).tolist() for ids in own.encode(texts)]
    assert got == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert len(asked) == len(set(asked)) < 100


def test_groups_of_texts_span_batches(monkeypatch):
    monkeypatch.setattr(token_files, "GROUP", 300)
    rng = random.Random(7)
    texts = ["x" * rng.choice((0, 5, 90, 700)) for _ in range(60)]
    rows = [pa.record_batch({"doc_id": pa.array(range(a, b), pa.int64()), "t": texts[a:b], "shard": pa.array([3] * (b - a), pa.int32())}) for a, b in ((0, 1), (1, 1), (1, 20), (20, 22), (22, 60))]
    groups = list(token_files._groups(rows))
    assert [t for _, _, some in groups for t in some] == texts and [i for _, ids, _ in groups for i in ids.to_pylist()] == list(range(60))
    assert all(shard == 3 and (len(some) == 1 or sum(len(t) + token_files.ROW for t in some) <= 300) for shard, _, some in groups)
    assert max(len(some) for _, _, some in groups) > 2 and not list(token_files._groups([]))
