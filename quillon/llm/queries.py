"""One query per operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import contamination, fingerprint, jaccard, langmodel, lines, mixing, secrets, tokens, toxicity, urls
from quillon.llm.shared import table

TOXIC_AT = 0.3

#: The given rules, as host and path prefix.
RULES = [
    urls.Rule("com", "/en/", "block"),
    urls.Rule("example.com", "/en/7", "allow"),
    urls.Rule("net", "/de/", "allow"),
    urls.Rule("example.net", "/de/8", "block"),
    urls.Rule("org", "/es/", "block"),
]

#: Weights of the quality domains in the mixture.
TARGETS = {"clean": 0.9, "low": 0.08, "toxic": 0.02}


def fold(parts: int):
    """A document's fold: the crc32 of its id as text, modulo ``parts``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(fold(4) != 2))
    scored = toxicity.score(docs, model, keep_text=False)
    return scored.select("doc_id", (fold(4) == 2).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= TOXIC_AT).cast("int").alias("predicted"), F.col("tox_evidence").alias("evidence"))


def op2_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.read_tokens(spark, tokens.write_tokens(docs, tokenizer_path(), end_id=1))


def op3_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return judged.select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"), F.col("url_template").alias("template"), F.col("url_purity").alias("purity"))


def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = secrets.history_of(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ledger = secrets.SecretLedger(spark)
    ledger.scan(history)
    found = ledger.report(history)
    kinds = [r.kind for r in secrets.BASE]

    def of(kind: str):
        return F.filter("spans", lambda s: s["kind"] == F.lit(kind))

    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return found.select(
        F.col("path").alias("doc_id"),
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(secrets.joined_spans(base), 256).alias("base_sha256"),
        secrets.joined_spans(F.col("spans")).alias("spans"),
        "blob",
    )


def op5_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=40, min_docs=5))


def op6_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = langmodel.score_documents(docs, fold(7) != 2)
    return scored.select("doc_id", (fold(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_components(table(spark, sf_dir, "documents").select("doc_id", "text"), n=4, threshold="0.85")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.find_contained(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), n=5, threshold=0.8)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_successor(table(spark, sf_dir, "documents").select("doc_id", "text"), k=128, n=5)


def labelled_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", mixing.quality_domains().alias("domain"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    mixed = mixing.mix(docs, labelled_domains(spark, sf_dir), TARGETS, keep=["doc_id"])
    posterior = [F.col("mix_posteriors")[i].alias(f"p_{d}") for i, d in enumerate(TARGETS)]
    return mixed.select("doc_id", F.col("mix_tokens").alias("n_tokens"), *posterior, F.col("mix_rate").alias("rate"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_toxicity, op2_token_planes, op3_url_templates, op4_secret_ledger, op5_line_runs,
            op6_bloom_lm, op7_jaccard_join, op8_decontamination, op9_fingerprints, op10_mixing,
        )
    }


_LINES = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d),
k AS (SELECT doc_id, i, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, (c.key IS NOT NULL AND k.doc_id < c.keeper) AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

_CONTAINED = r"""
WITH t AS (
  SELECT true AS is_doc, doc_id AS id, text FROM documents UNION ALL SELECT false, item_id, text FROM benchmark),
w AS (SELECT is_doc, id, regexp_extract_all(regexp_replace(lower(coalesce(text, '')),
      '[!-/:-@\[-`{-~]', ' ', 'g'), '[^\x20\x09-\x0D]+') AS v FROM t),
s AS (SELECT DISTINCT is_doc, id, array_to_string(v[i:i+4], ' ') AS g
      FROM (SELECT is_doc, id, v, unnest(range(1, len(v) - 3)) AS i FROM w WHERE len(v) >= 5)),
n AS (SELECT id, count(*) AS m FROM s WHERE NOT is_doc GROUP BY id)
SELECT a.id AS doc_id, b.id AS item_id, count(*) AS n_shared, any_value(n.m) AS n_item, count(*) / any_value(n.m) AS containment
FROM s a JOIN s b ON a.g = b.g AND a.is_doc AND NOT b.is_doc JOIN n ON n.id = b.id
GROUP BY a.id, b.id HAVING count(*) >= 0.8 * any_value(n.m)
"""


_LINKED = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS v FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(v[i:i+3], ' ') AS s FROM (SELECT doc_id, v, unnest(range(1, greatest(len(v) - 2, least(len(v) + 1, 2)))) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS k FROM g GROUP BY doc_id),
r AS (SELECT k, min(doc_id) AS rep, any_value(n) AS n FROM n GROUP BY k),
w AS (SELECT r.rep, r.n, g.s FROM r JOIN g ON g.doc_id = r.rep),
p AS (SELECT a.rep AS a, b.rep AS b FROM w a JOIN w b ON a.s = b.s AND a.rep <> b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
t AS (SELECT rep AS a, rep AS m FROM r UNION SELECT p.b, t.m FROM t JOIN p ON p.a = t.a),
c AS (SELECT a, min(m) AS m FROM t GROUP BY a), l AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.m, d.doc_id) AS component_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.k = n.k LEFT JOIN c ON c.a = r.rep LEFT JOIN l ON l.a = r.rep
"""


def oracle_sql() -> dict[str, str]:
    """The others are not expressible in SQL (sketches, iterative fits, files) and are tested against brute force."""
    return {"op5_line_runs": _LINES, "op7_jaccard_join": _LINKED, "op8_decontamination": _CONTAINED}
