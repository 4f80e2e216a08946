"""Registered queries of this folder and their SQL; each applies its operator to the whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import bpe, exact_dedup, langid, lm_bloom, merkle, mixing, pu_quality, simhash, spelling, syncmers, token_files, vector_graph, warc
from tidepool.llm.common import held_out

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
#: Shares of the mixture by domain; the first domain's expected tokens are wanted EPOCHS times.
MIXTURE = {"clean": 0.92, "low": 0.05, "toxic": 0.03}
EPOCHS = 1.05


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def op1_closed_syncmers(spark: SparkSession, d: str) -> DataFrame:
    return syncmers.fingerprints(_table(spark, d, "documents"))


def op2_warc_salvage(spark: SparkSession, d: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, d, "pages"), token_files.new_folder(spark, "warc"))


def op3_bloom_lm(spark: SparkSession, d: str) -> DataFrame:
    return lm_bloom.score(_table(spark, d, "documents"), ~held_out("doc_id", 5, 1))


def op4_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, d, "documents"))


def op5_soft_mixing(spark: SparkSession, d: str) -> DataFrame:
    """Per document: doc_id, n_tokens, rate, n_copies, and its posterior of each domain."""
    docs, labels = _table(spark, d, "documents"), mixing.label_domains(_table(spark, d, "labels"))
    _, fitted, table = mixing.soft_rates(docs, labels, MIXTURE, EPOCHS)
    posteriors = [F.get("post", F.lit(i)).alias(f"p_{name}") for i, name in enumerate(MIXTURE)]
    rated = table.withColumn("rate", mixing.rate(F.col("post"), fitted))
    return rated.select("doc_id", F.col("tokens").alias("n_tokens"), "rate", (F.col("rate") * F.col("tokens")).alias("expected_tokens"), *posteriors)


def op6_arrow_sequences(spark: SparkSession, d: str) -> DataFrame:
    with open(TOKENIZER, encoding="utf-8") as file:
        definition = file.read()
    folder = token_files.new_folder(spark, "tokens")
    return token_files.read_documents(token_files.write_shards(_table(spark, d, "documents"), definition, END_ID, folder))


def op7_pu_quality(spark: SparkSession, d: str) -> DataFrame:
    docs, test = _table(spark, d, "documents"), held_out("doc_id", 5, 0)
    model = pu_quality.train(docs, _table(spark, d, "labels"), ~test)
    scored = pu_quality.with_score(docs, model).select("doc_id", test.alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= pu_quality.THRESHOLD).cast("int"))


def language_model(docs: DataFrame) -> langid.Model:
    return langid.train(docs, ~held_out("doc_id", 4, 2))


def op8_nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    found = langid.predict(docs, language_model(docs))
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score", "language.rejected")


def op9_simhash_variants(spark: SparkSession, d: str) -> DataFrame:
    return simhash.groups(_table(spark, d, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_duckdb_bpe(spark: SparkSession, d: str) -> DataFrame:
    return bpe.round_trip(_table(spark, d, "documents"), bpe.read_ranks(spark, RANKS), public_tokenizers.PATTERN)


def op11_merkle_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Proofs of every document; where 7 divides the crc32 of the id, the row to verify has one more in n_chars."""
    docs = _table(spark, d, "documents")
    touched = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    claim = F.when(touched, merkle.leaf_hash(*[more if f == "n_chars" else F.col(f) for f in merkle.FIELDS]))
    return merkle.verified(merkle.proofs(docs, claim=claim))


def op12_robust_graph(spark: SparkSession, d: str) -> DataFrame:
    return vector_graph.groups(_table(spark, d, "embeddings"))


def op13_spelling_variants(spark: SparkSession, d: str) -> DataFrame:
    return spelling.variants(_table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    chosen = (
        op1_closed_syncmers, op2_warc_salvage, op3_bloom_lm, op4_exact_dedup, op5_soft_mixing, op6_arrow_sequences, op7_pu_quality,
        op8_nearest_centroid, op9_simhash_variants, op10_duckdb_bpe, op11_merkle_manifest, op12_robust_graph,
        op13_spelling_variants,
    )
    return {f.__name__: f for f in chosen}


#: crc32 of an ASCII text, as DuckDB has none: eight shifts for each byte.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 1, 2, 3, 4, 5, 6, 7, 8],
    lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"""


#: The same of any text, by the hex digits of its UTF-8 bytes.
_CRC_UTF8 = _CRC.replace(
    "list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)",
    "list_transform(regexp_extract_all(hex({0}), '..'), lambda c: ('0x' || c)::BIGINT)",
)


def _spelling_sql() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""WITH RECURSIVE runs AS (
          SELECT doc_id, translate(run, '{upper}', '{upper.lower()}') AS run, count(*) AS n
          FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
          WHERE length(run) >= {spelling.LEAST_LETTERS} GROUP BY ALL),
        hashed AS (SELECT *, {_CRC_UTF8.format("(doc_id::VARCHAR || ':' || run)")} AS h FROM runs),
        words AS (
          SELECT CASE WHEN h % {spelling.TYPO} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word,
            sum(n)::BIGINT AS n FROM hashed GROUP BY 1),
        vocab AS (SELECT * FROM words WHERE n >= {spelling.LEAST_COUNT} AND length(word) >= {spelling.LEAST_LETTERS}),
        cuts AS (
          SELECT word, n, i, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS rest FROM vocab, range(1, 1000000) t(i) WHERE i <= length(word)),
        pairs AS (
          SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
          UNION SELECT a.word, b.word, b.n FROM cuts a JOIN vocab b ON a.rest = b.word
          UNION SELECT b.word, a.word, a.n FROM cuts a JOIN vocab b ON a.rest = b.word),
        best AS (
          SELECT word, count(*) AS n_near, arg_min(other, row(-m, other)) AS other, max(m) AS m FROM pairs GROUP BY word),
        formed AS (
          SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {spelling.FORM_RATIO} * v.n THEN other END AS form,
            CASE WHEN m >= {spelling.FORM_RATIO} * v.n THEN m END AS form_n FROM vocab v LEFT JOIN best b ON b.word = v.word),
        led AS (SELECT word, word AS root FROM formed UNION ALL SELECT l.word, f.form FROM led l JOIN formed f ON f.word = l.root WHERE f.form IS NOT NULL),
        ends AS (SELECT l.word, l.root FROM led l JOIN formed f ON f.word = l.root WHERE f.form IS NULL)
        SELECT f.word, form, root, n, n_near, form_n FROM formed f JOIN ends e ON e.word = f.word"""


def _merkle_sql() -> str:
    part = "coalesce(strlen({0}) || ':' || {0}, '-')"
    text = ["doc_id::VARCHAR", "source", "lang", "{n}::VARCHAR", "text"]
    leaf = lambda n: "sha256(" + " || ".join(part.format(t.format(n=n)) for t in text) + ")"
    return f"""WITH RECURSIVE leaves AS (
          SELECT doc_id, coalesce('=' || lang, '-') AS g, {leaf('n_chars')} AS leaf,
            CASE WHEN {_CRC.format("doc_id::VARCHAR")} % 7 = 0 THEN {leaf('(n_chars + 1)')} ELSE {leaf('n_chars')} END AS claim FROM documents),
        placed AS (
          SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST) - 1 AS idx, count(*) OVER (PARTITION BY g) AS m FROM leaves),
        up AS (
          SELECT g, 0 AS lvl, idx, m, leaf AS h FROM placed
          UNION ALL
          SELECT g, lvl + 1, idx // 2, max(m + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM up WHERE m > 1 GROUP BY g, lvl, idx // 2),
        subs AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS m FROM up WHERE m = 1),
        over_groups AS (
          SELECT 0 AS lvl, idx, m, h FROM subs
          UNION ALL
          SELECT lvl + 1, idx // 2, max(m + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM over_groups WHERE m > 1 GROUP BY lvl, idx // 2),
        steps AS (
          SELECT p.doc_id, u.lvl, u.h, u.idx < (p.idx >> u.lvl) AS is_left FROM placed p JOIN up u ON u.g = p.g AND u.idx = xor(p.idx >> u.lvl, 1)
          UNION ALL
          SELECT p.doc_id, 1000 + o.lvl, o.h, o.idx < (s.idx >> o.lvl) FROM placed p JOIN subs s ON s.g = p.g
          JOIN over_groups o ON o.idx = xor(s.idx >> o.lvl, 1)),
        alone AS (
          SELECT p.doc_id, u.lvl, '' AS h, true AS is_left FROM placed p JOIN up u ON u.g = p.g AND u.idx = (p.idx >> u.lvl) AND u.m > 1
          UNION ALL
          SELECT p.doc_id, 1000 + o.lvl, '', true FROM placed p JOIN subs s ON s.g = p.g JOIN over_groups o ON o.idx = (s.idx >> o.lvl) AND o.m > 1),
        every AS (
          SELECT a.doc_id, a.lvl, coalesce(s.h, '') AS h, coalesce(s.is_left, true) AS is_left
          FROM alone a LEFT JOIN steps s ON s.doc_id = a.doc_id AND s.lvl = a.lvl),
        paths AS (
          SELECT doc_id, sha256(string_agg(h, '' ORDER BY lvl)) AS proof_sha256,
            list(CASE WHEN is_left THEN {{'l': h, 'r': ''}} ELSE {{'l': '', 'r': h}} END ORDER BY lvl) AS path FROM every GROUP BY doc_id),
        folded AS (
          SELECT p.doc_id, p.leaf, s.h AS subroot, (SELECT h FROM over_groups WHERE m = 1) AS root,
            coalesce(t.proof_sha256, sha256('')) AS proof_sha256,
            list_reduce(list_prepend({{'l': p.claim, 'r': ''}}, coalesce(t.path, [])), lambda a, x: {{'l': sha256(x.l || a.l || x.r), 'r': ''}}).l AS folded_root
          FROM placed p JOIN subs s ON s.g = p.g LEFT JOIN paths t ON t.doc_id = p.doc_id)
        SELECT *, folded_root = root AS verified FROM folded"""


_WHITE = r"[\x20\x09-\x0D]"


def oracle_sql() -> dict[str, str]:
    return {
        "op11_merkle_manifest": _merkle_sql(),
        "op12_robust_graph": """WITH RECURSIVE v AS (
              SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
              WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
            links AS (SELECT a.vec_id, b.vec_id AS other FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
              AND list_cosine_similarity(a.e, b.e) >= 0.95),
            reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.other FROM reach r JOIN links l ON l.vec_id = r.other),
            classes AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
            SELECT c.vec_id, count(l.other) AS n_links, component_id, c.vec_id = component_id AS kept
            FROM classes c LEFT JOIN links l ON l.vec_id = c.vec_id GROUP BY c.vec_id, component_id""",
        "op13_spelling_variants": _spelling_sql(),
        "op4_exact_dedup": f"""WITH bare AS (
              SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '{_WHITE}', '', 'g')) AS text_sha256
              FROM documents),
            ranked AS (
              SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id FROM bare)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked""",
    }
