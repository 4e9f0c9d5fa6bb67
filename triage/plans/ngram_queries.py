"""Registered n-gram queries (family F): ``documents`` is the corpus and
``benchmark`` the prompt table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ngram as G
from ..sources.tables import read_table, table_path

N = 3  # trigram model, as in the lab
TOP_K = 30  # tokens shown per prompt
GEN_TOKENS = 50  # tokens generated per prompt
SEED = 7


def _corpus(spark, sf_dir):
    return G.read_corpus(spark, table_path(sf_dir, "documents"))


def _prompts(spark, sf_dir):
    return read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("prompt_id"), "text")


def _counts(spark, sf_dir):
    """Counts dealt by context, for what is grouped by it."""
    corpus = _corpus(spark, sf_dir)
    return G.ngram_counts(corpus, N, buckets=G.context_buckets(corpus))


def q_corpus_stats(spark, sf_dir):
    toks = G.tokenize(F.col("text"))
    return read_table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(F.size(toks)).cast("bigint").alias("n_tokens"),
        F.sum(F.greatest(F.size(toks) - (N - 1), F.lit(0))).cast("bigint").alias("n_trigrams"),
    )


def q_ngram_counts(spark, sf_dir):
    return G.ngram_counts(_corpus(spark, sf_dir), N).sortWithinPartitions("context", "token")


def q_ngram_model(spark, sf_dir):
    return G.ngram_model(_counts(spark, sf_dir))


def _prompt_model(spark, sf_dir, prompts):
    return G.context_model(_corpus(spark, sf_dir), G.with_context(prompts, N), N)


def q_next_tokens(spark, sf_dir):
    p = _prompts(spark, sf_dir)
    return G.next_tokens(p, _prompt_model(spark, sf_dir, p), N, TOP_K)


def q_unseen_prompts(spark, sf_dir):
    p = _prompts(spark, sf_dir)
    return G.unseen(p, _prompt_model(spark, sf_dir, p), N)


def q_greedy_generation(spark, sf_dir):
    return G.generate_greedy(_prompts(spark, sf_dir), _counts(spark, sf_dir), GEN_TOKENS, N)


def q_random_generation(spark, sf_dir):
    return G.generate_random(_prompts(spark, sf_dir), _counts(spark, sf_dir), GEN_TOKENS, SEED, N)


def _trimmed():
    return F.regexp_replace("text", "^[^ ]* ", "")


def _pairs(spark, sf_dir):
    p = _prompts(spark, sf_dir)
    trimmed = p.select(
        (F.col("prompt_id") * 2).alias("pair_id"),
        F.col("text").alias("text_a"),
        _trimmed().alias("text_b"),
    )
    nxt = p.alias("a").join(p.alias("b"), F.col("b.prompt_id") == F.col("a.prompt_id") + 1).select(
        (F.col("a.prompt_id") * 2 + 1).alias("pair_id"), F.col("a.text").alias("text_a"), F.col("b.text").alias("text_b")
    )
    return trimmed.unionByName(nxt)


def q_prompt_comparison(spark, sf_dir):
    pairs, prompts = _pairs(spark, sf_dir), _prompts(spark, sf_dir).select("text")
    ctx = prompts.unionByName(prompts.select(_trimmed().alias("text")))  # all texts of the pairs
    model = G.context_model(_corpus(spark, sf_dir), G.with_context(ctx, N), N)
    return G.compare_prompts(pairs, model, N)


QUERIES = {
    "corpus_stats": q_corpus_stats,
    "ngram_counts": q_ngram_counts,
    "ngram_model": q_ngram_model,
    "next_tokens": q_next_tokens,
    "unseen_prompts": q_unseen_prompts,
    "greedy_generation": q_greedy_generation,
    "random_generation": q_random_generation,
    "prompt_comparison": q_prompt_comparison,
}

_COUNTS = """tk AS (
  SELECT doc_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos
  FROM (SELECT doc_id, string_split(text, ' ') AS toks FROM documents)
),
counts AS MATERIALIZED (
  SELECT a.tok || ' ' || b.tok AS context, c.tok AS token, count(*) AS n
  FROM tk a JOIN tk b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1
            JOIN tk c ON c.doc_id = a.doc_id AND c.pos = a.pos + 2
  GROUP BY 1, 2
),
model AS (
  SELECT c.context, c.token, c.n, c.n / t.ctx_n AS prob
  FROM counts c JOIN (SELECT context, sum(n) AS ctx_n FROM counts GROUP BY context) t ON c.context = t.context
),
p AS MATERIALIZED (SELECT item_id AS prompt_id, text, string_split(text, ' ') AS toks FROM benchmark),
pc AS (
  SELECT prompt_id, CASE WHEN len(toks) >= 2 THEN array_to_string(toks[len(toks) - 1:len(toks)], ' ') END AS context
  FROM p
)"""


def _ctx(col):
    return (
        f"CASE WHEN len(string_split({col}, ' ')) >= 2 THEN array_to_string("
        f"string_split({col}, ' ')[len(string_split({col}, ' ')) - 1:len(string_split({col}, ' '))], ' ') END"
    )


ORACLE = {
    "corpus_stats": """SELECT lang, count(*) AS n_docs,
  CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS n_tokens,
  CAST(sum(greatest(len(string_split(text, ' ')) - 2, 0)) AS BIGINT) AS n_trigrams
FROM documents GROUP BY lang""",
    "ngram_counts": f"WITH {_COUNTS}\nSELECT context, token, n FROM counts",
    "ngram_model": f"WITH {_COUNTS}\nSELECT context, token, n, prob FROM model",
    "next_tokens": f"""WITH {_COUNTS}
SELECT prompt_id, context, rank, token, prob FROM (
  SELECT pc.prompt_id, pc.context, model.token, model.prob,
    CAST(row_number() OVER (PARTITION BY pc.prompt_id ORDER BY model.prob DESC, model.token) AS BIGINT) AS rank
  FROM pc JOIN model ON pc.context = model.context)
WHERE rank <= {TOP_K}""",
    "unseen_prompts": f"""WITH {_COUNTS}
SELECT prompt_id, context FROM pc WHERE context IS NULL OR context NOT IN (SELECT context FROM counts)""",
    "greedy_generation": f"""WITH RECURSIVE {_COUNTS},
best AS MATERIALIZED (SELECT context, arg_min(token, (-n, token)) AS nxt FROM counts GROUP BY context),
gen AS (
  SELECT prompt_id, 0 AS step, CASE WHEN len(toks) >= 2 THEN toks[len(toks) - 1:len(toks)] END AS ctx,
    CAST([] AS VARCHAR[]) AS out
  FROM p
  UNION ALL
  SELECT g.prompt_id, g.step + 1, list_append(g.ctx[2:2], b.nxt), list_append(g.out, b.nxt)
  FROM gen g JOIN best b ON array_to_string(g.ctx, ' ') = b.context
  WHERE g.step < {GEN_TOKENS}
)
SELECT prompt_id, array_to_string(arg_max(out, step), ' ') AS generated, CAST(max(step) AS BIGINT) AS n_generated
FROM gen GROUP BY prompt_id""",
    "random_generation": f"""WITH RECURSIVE {_COUNTS},
ranges AS MATERIALIZED (
  SELECT context, token, n, CAST(sum(n) OVER (
      PARTITION BY context ORDER BY substr(md5(token), 1, 2), token ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hi,
    CAST(sum(n) OVER (PARTITION BY context) AS BIGINT) AS total
  FROM counts
),
gen AS (
  SELECT prompt_id, 0 AS step, CASE WHEN len(toks) >= 2 THEN toks[len(toks) - 1:len(toks)] END AS ctx,
    CAST([] AS VARCHAR[]) AS out
  FROM p
  UNION ALL
  SELECT g.prompt_id, g.step + 1, list_append(g.ctx[2:2], r.token), list_append(g.out, r.token)
  FROM (SELECT *, CAST('0x' || substr(md5('{SEED}|' || prompt_id || '|' || step), 1, 15) AS BIGINT) AS draw FROM gen) g
  JOIN ranges r ON array_to_string(g.ctx, ' ') = r.context AND g.draw % r.total >= r.hi - r.n AND g.draw % r.total < r.hi
  WHERE g.step < {GEN_TOKENS}
)
SELECT prompt_id, array_to_string(arg_max(out, step), ' ') AS generated, CAST(max(step) AS BIGINT) AS n_generated
FROM gen GROUP BY prompt_id""",
    "prompt_comparison": f"""WITH {_COUNTS},
pairs AS (
  SELECT item_id * 2 AS pair_id, text AS text_a, regexp_replace(text, '^[^ ]* ', '') AS text_b FROM benchmark
  UNION ALL
  SELECT a.item_id * 2 + 1, a.text, b.text FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1
),
pctx AS (SELECT pair_id, {_ctx('text_a')} AS ca, {_ctx('text_b')} AS cb FROM pairs),
da AS (SELECT pair_id, token, prob AS pa FROM pctx JOIN model ON pctx.ca = model.context),
db AS (SELECT pair_id, token, prob AS pb FROM pctx JOIN model ON pctx.cb = model.context),
j AS (SELECT coalesce(da.pair_id, db.pair_id) AS pair_id, pa, pb FROM da FULL OUTER JOIN db
      ON da.pair_id = db.pair_id AND da.token = db.token),
agg AS (SELECT pair_id, count(pa) AS n_a, count(pb) AS n_b, count(*) FILTER (WHERE pa IS NOT NULL AND pb IS NOT NULL) AS n_common,
          max(abs(coalesce(pa, 0.0) - coalesce(pb, 0.0))) AS max_diff FROM j GROUP BY pair_id)
SELECT pairs.pair_id, CAST(coalesce(n_a, 0) AS BIGINT) AS n_a, CAST(coalesce(n_b, 0) AS BIGINT) AS n_b,
  CAST(coalesce(n_common, 0) AS BIGINT) AS n_common, CAST(coalesce(max_diff, 0.0) AS DOUBLE) AS max_diff,
  coalesce(max_diff, 0.0) = 0 AS same_distribution
FROM pairs LEFT JOIN agg ON pairs.pair_id = agg.pair_id""",
}
