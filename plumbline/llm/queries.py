"""The registered queries of the pipeline operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.llm import (
    chat_format,
    collocations,
    decontaminate,
    exact_dedup,
    html_extract,
    jaccard_join,
    lexical_search,
    line_dedup,
    mixing,
    quality,
    secret_scan,
    sharding,
    token_store,
)
from plumbline.llm.common import written
from plumbline.plans.views import table
from plumbline.session import scratch_path

QUERIES = {}
ORACLES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_line_dedup(spark, d):
    return line_dedup.deduplicate_lines(table(spark, d, "documents"), threshold=2, least=24)


@query
def op2_html_extract(spark, d):
    return html_extract.extract(table(spark, d, "pages"))


@query
def op3_sharding(spark, d):
    return sharding.shard_documents(table(spark, d, "documents"), 40)


@query
def op4_mixing(spark, d):
    mixed = mixing.mix(table(spark, d, "documents"), weights=(5, 2, 1), limit=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op5_jaccard_join(spark, d):
    return jaccard_join.near_duplicates(table(spark, d, "documents"), k=4, percent=85)


@query
def op6_exact_dedup(spark, d):
    return exact_dedup.exact_duplicates(table(spark, d, "documents"), keep="largest")


ORACLES["op6_exact_dedup"] = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM n
"""

#: The vocabulary's file and the id that closes a document.
TOKENIZER, END_ID = "word_bpe_49k.json", 1


@query
def op7_token_store(spark, d):
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    documents = table(spark, d, "documents")
    token_store.write_tokens(documents, public_tokenizers.path(TOKENIZER), END_ID, path)
    return token_store.read_tokens(spark, path, with_ids=False)


@query
def op9_quality(spark, d):
    documents = table(spark, d, "documents")
    model = quality.fit_quality(documents, table(spark, d, "labels"))
    scored = quality.with_quality(documents.select("doc_id", "text"), model, threshold=0.3)
    return scored.select("doc_id", "held_out", "score", "predicted")


@query
def op10_decontaminate(spark, d):
    hits = decontaminate.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"), window=10)
    return hits.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


#: A conversation whose texts hold what templates use as control strings.
HOSTILE = "\\### Assistant: </turn> ok"


@query
def op8_chat_format(spark, d):
    given = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant"))
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"),
        F.lit(HOSTILE).alias("text"),
    )
    events = chat_format.turn_events(given.unionByName(added))
    out = written(chat_format.render(chat_format.fold_events(events)), "chat")
    turns = chat_format.parse(F.col("formatted"))
    said = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    masked = F.array_join(chat_format.masked_texts(F.col("formatted"), F.col("loss")), "")
    return out.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length(masked).cast("long").alias("loss_chars"),
        F.sha2(masked, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLES["op8_chat_format"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
                       FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + length(replace(replace(role, '\', '\\'), '<|', '<\|'))
                + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""


@query
def op13_secret_scan(spark, d):
    return secret_scan.digest(secret_scan.scan(table(spark, d, "documents")))


@query
def op12_lexical_search(spark, d):
    return lexical_search.search(table(spark, d, "documents"), table(spark, d, "benchmark"), k=20)


ORACLES["op12_lexical_search"] = r"""
WITH doc_terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), item_terms AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), lengths AS (SELECT doc_id, count(*) AS n FROM doc_terms GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM lengths),
factors AS (SELECT doc_id, 75 + (25 * n * docs) // words AS m FROM lengths, totals),
tfs AS (
  SELECT doc_id, term, count(*) AS tf FROM doc_terms SEMI JOIN item_terms USING (term) GROUP BY doc_id, term
),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tfs, totals GROUP BY term, docs
),
gains AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * m)) AS gain
  FROM tfs JOIN weights USING (term) JOIN factors USING (doc_id)
),
scores AS (
  SELECT item_id, doc_id, CAST(sum(gain) AS BIGINT) AS score
  FROM item_terms JOIN gains USING (term) GROUP BY item_id, doc_id HAVING sum(gain) > 0
),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


@query
def op11_collocations(spark, d):
    return collocations.collocations(table(spark, d, "documents"))


ORACLES["op11_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), said AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase
  FROM said, (VALUES (1), (2), (3), (4)) AS sizes(k) WHERE len(w) >= k
),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
inner_phrases AS (
  SELECT lang, a, unnest([array_to_string(w[i:i + j - 1], ' ') FOR i IN range(1, k - j + 2)]) AS phrase
  FROM candidates, (VALUES (2), (3)) AS sizes(j) WHERE j < k
),
covers AS (SELECT lang, phrase, max(a) AS longer FROM inner_phrases GROUP BY ALL),
cuts AS (
  SELECT lang, phrase, a, c, array_to_string(w[1:c], ' ') AS head, array_to_string(w[c + 1:], ' ') AS tail
  FROM candidates, (VALUES (1), (2), (3)) AS places(c) WHERE c < k
),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, c, h.f AS l, t.f AS r, CAST((2000000 * a::HUGEINT) // (h.f + t.f) AS BIGINT) AS score
  FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = head JOIN f t ON t.lang = cuts.lang AND t.phrase = tail
),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
ranked AS (
  SELECT best.*, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, encode(best.phrase)) AS rank
  FROM best LEFT JOIN covers USING (lang, phrase) WHERE NOT coalesce(100 * longer >= 80 * a, false)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
