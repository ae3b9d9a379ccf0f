"""The production queries of this subpackage, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm._common import table
from kerbside.llm.chat import rotate_perspectives
from kerbside.llm import language_id, passage_quality, toxicity
from kerbside.llm.decontamination import find_items
from kerbside.llm.hard_negatives import mine
from kerbside.llm.lm_scoring import pseudo_likelihood
from kerbside.llm.mixing import MixTree, mix
from kerbside.llm.near_dup import near_duplicates
from kerbside.llm.quality import quality_rules
from kerbside.llm.repair import repair_report
from kerbside.llm.sharding import shard_plan
from kerbside.llm.token_counts import count_tokens


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_plan(table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rotate_perspectives(table(spark, sf_dir, "conversations"))
    spans = F.transform("mask_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return out.withColumn("mask_spans", F.array_join(spans, ","))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs.select("doc_id", "text"), model).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
        "toxic_hits",
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit_languages(docs)
    return language_id.predict_language(docs.select("doc_id", "text"), model).select(
        "doc_id",
        language_id.held_out(F.col("doc_id")).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
    )


#: Domains by source, and the weights of the production mixture.
DOMAINS = {"web": ("src0", "src1", "src2", "src3", "src4"), "news": ("src5", "src6", "src7", "src8", "src9"), "books": ("src10", "src11", "src12", "src13")}
WEIGHTS = {"web": 4, "news": 3, "books": 2, "other": 1, **{f"{d}/en": 3 for d in (*DOMAINS, "other")}, "web/en/src0": 2}


def domain() -> Column:
    out = F.lit("other")
    for name, sources in DOMAINS.items():
        out = F.when(F.col("source").isin(*sources), name).otherwise(out)
    return out


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), MixTree(WEIGHTS), domain(), share=0.8, max_epochs=2).drop("_text")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(table(spark, sf_dir, "documents"))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4).drop("_node")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_items(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("contained").alias("hit")).select(
        "doc_id", "hit.item_id", "hit.n_shared", "hit.n_item", (F.col("hit.n_shared") / F.col("hit.n_item")).alias("containment")
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 6) + 0.0 for c in ("char_distance", "word_distance")})


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(table(spark, sf_dir, "conversations"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    # from 2**53 on a double is whole already; what is not finite stays so, and its row takes no part
    whole = lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)
    vectors = F.transform("embedding", lambda x: whole(x.cast("double") * 256))
    return mine(rows.select("vec_id", label.alias("label"), vectors.alias("embedding")), F.col("id") % 50 == 0)


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = passage_quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return passage_quality.score_quality(docs.select("doc_id", "text"), model).select(
        "doc_id",
        passage_quality.held_out(F.col("doc_id")).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.7).cast("int").alias("predicted"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_sharding": op2_sharding,
    "op3_mixing": op3_mixing,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_toxicity": op5_toxicity,
    "op6_language_id": op6_language_id,
    "op7_near_dup": op7_near_dup,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_decontamination": op9_decontamination,
    "op10_quality_rules": op10_quality_rules,
    "op11_structure_repair": op11_structure_repair,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_quality_classifier": op13_quality_classifier,
}

ORACLE_SQL: dict[str, str] = {
    "op4_chat_formatting": """
        WITH m AS (
            SELECT conv_id, turn,
                   coalesce(role, 'unknown') AS speaker,
                   replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) AS body
            FROM conversations WHERE conv_id IS NOT NULL
        ), people AS (
            SELECT DISTINCT conv_id, speaker AS perspective FROM m WHERE speaker <> 'system'
        ), pieces AS (
            SELECT m.*, perspective,
                   CASE WHEN speaker = 'system' THEN '<|system|>' || chr(10)
                        WHEN speaker = perspective THEN '<|assistant|>' || chr(10)
                        ELSE '<|user name=' || replace(speaker, '|>', '| >') || '|>' || chr(10) END AS head
            FROM m JOIN people USING (conv_id)
        ), placed AS (
            SELECT *, row_number() OVER w AS n,
                   sum(length(head) + length(body)) OVER (w ROWS UNBOUNDED PRECEDING) AS stop
            FROM pieces WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body)
        )
        SELECT conv_id, perspective, count(*) AS n_messages,
               string_agg(head || body, '' ORDER BY n) AS rendered,
               coalesce(string_agg((stop - length(body))::VARCHAR || ':' || stop::VARCHAR, ',' ORDER BY n)
                   FILTER (WHERE speaker = perspective), '') AS mask_spans,
               coalesce(sum(length(body)) FILTER (WHERE speaker = perspective), 0)::BIGINT AS target_chars
        FROM placed GROUP BY conv_id, perspective
    """,
    "op3_mixing": r"""
        WITH r AS (
            SELECT doc_id, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
                   CASE WHEN source IN ('src0','src1','src2','src3','src4') THEN 'web' WHEN source IN ('src5','src6','src7','src8','src9') THEN 'news'
                        WHEN source IN ('src10','src11','src12','src13') THEN 'books' ELSE 'other' END AS domain,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens
            FROM documents
        ), leaf AS (SELECT domain, lang, source, sum(n_tokens)::DOUBLE AS tokens, 2.0 * sum(n_tokens)::DOUBLE AS cap FROM r GROUP BY ALL),
        d AS (
            SELECT *, CASE WHEN full_ THEN capacity ELSE weight * (budget - coalesce(sum(capacity) FILTER (WHERE full_) OVER (PARTITION BY 1), 0))
                / sum(weight) FILTER (WHERE NOT full_) OVER (PARTITION BY 1) END AS got
            FROM (SELECT *, coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                    + capacity / weight * sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= budget + 1e-6 AS full_
                  FROM (SELECT domain, sum(cap) AS capacity, (CASE domain WHEN 'web' THEN 4 WHEN 'news' THEN 3 WHEN 'books' THEN 2 ELSE 1 END)::DOUBLE AS weight, 0.8 * (SELECT sum(tokens) FROM leaf) AS budget FROM leaf GROUP BY domain) WHERE capacity > 0 WINDOW w AS (PARTITION BY 1 ORDER BY capacity / weight, domain))
        ),
        l AS (
            SELECT *, CASE WHEN full_ THEN capacity ELSE weight * (budget - coalesce(sum(capacity) FILTER (WHERE full_) OVER (PARTITION BY domain), 0))
                / sum(weight) FILTER (WHERE NOT full_) OVER (PARTITION BY domain) END AS got
            FROM (SELECT *, coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                    + capacity / weight * sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= budget + 1e-6 AS full_
                  FROM (SELECT domain, lang, sum(cap) AS capacity, (CASE lang WHEN 'en' THEN 3 ELSE 1 END)::DOUBLE AS weight, any_value(d.got) AS budget FROM leaf JOIN d USING (domain) GROUP BY domain, lang) WHERE capacity > 0 WINDOW w AS (PARTITION BY domain ORDER BY capacity / weight, lang))
        ),
        s AS (
            SELECT *, CASE WHEN full_ THEN capacity ELSE weight * (budget - coalesce(sum(capacity) FILTER (WHERE full_) OVER (PARTITION BY domain, lang), 0))
                / sum(weight) FILTER (WHERE NOT full_) OVER (PARTITION BY domain, lang) END AS got
            FROM (SELECT *, coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                    + capacity / weight * sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= budget + 1e-6 AS full_
                  FROM (SELECT leaf.domain, leaf.lang, source, tokens, cap AS capacity, (CASE WHEN leaf.domain = 'web' AND leaf.lang = 'en' AND source = 'src0' THEN 2 ELSE 1 END)::DOUBLE AS weight, l.got AS budget FROM leaf JOIN l USING (domain, lang)) WHERE capacity > 0 WINDOW w AS (PARTITION BY domain, lang ORDER BY capacity / weight, source))
        ),
        p AS (
            SELECT r.*, leaf_budget, epochs, leaf_budget - epochs * tokens AS rest,
                   (('0x' || substr(md5('17:' || epochs::VARCHAR || ':' || doc_id::VARCHAR), 1, 13))::BIGINT + 0.5) / 4503599627370496 AS h
            FROM r JOIN (SELECT domain, lang, source, tokens, floor(got + 1e-6)::BIGINT AS leaf_budget, floor(floor(got + 1e-6) / tokens)::INT AS epochs FROM s)
                USING (domain, lang, source)
        )
        SELECT doc_id, domain, lang, source, n_tokens, leaf_budget, unnest(range(epochs))::INT AS epoch FROM p
        UNION ALL
        SELECT doc_id, domain, lang, source, n_tokens, leaf_budget, epochs AS epoch FROM (
            SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM p
        ) WHERE before_ < rest
    """,
    "op9_decontamination": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), ds AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
        ), b AS (
            SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark
        ), bs AS (
            SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS s
            FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b WHERE len(w) >= 5)
        ), n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
        SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item) AS containment
        FROM ds JOIN bs USING (s) JOIN n USING (item_id)
        GROUP BY doc_id, item_id HAVING 100 * count(*) >= 80 * any_value(n_item)
    """,
    "op10_quality_rules": r"""
        WITH d AS (
            SELECT doc_id, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
                   list_filter(regexp_split_to_array(lower(t), '[\x20\x09-\x0D.,;:!?]+'), lambda x: x <> '') AS tok,
                   list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS li
            FROM (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents)
        ), g AS (
            SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
        ), rep AS (
            SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
            FROM (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1), (SELECT unnest(range(5)) AS k) GROUP BY doc_id
        ), cl AS (
            SELECT doc_id, [length(t) - length(regexp_replace(t, '\p{Lu}+', '', 'g')), length(t) - length(regexp_replace(t, '[0-9]+', '', 'g')),
                            length(t) - length(regexp_replace(t, '[.,;:!?''"()\-]+', '', 'g')), length(t) - length(regexp_replace(t, '[#*$%&|<>{}\[\]=+/\\_@^~`]+', '', 'g'))] AS c
            FROM d
        ), f AS (
            SELECT doc_id, lang, tok, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
                   len(li) - len(list_distinct(li)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                   len(w) < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * len(w) AS base_failed, c
            FROM d LEFT JOIN rep USING (doc_id) JOIN cl USING (doc_id)
        ), tw AS (SELECT doc_id, lang, unnest(tok) AS word FROM d WHERE lang IS NOT NULL),
        cw AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS k FROM tw GROUP BY lang, word QUALIFY k <= 20),
        hit AS (SELECT doc_id, k, count(*) AS n FROM tw JOIN cw USING (lang, word) GROUP BY doc_id, k),
        hw AS (
            SELECT f.doc_id, lang, base_failed, x.k, coalesce(hit.n, 0) AS n FROM f JOIN (SELECT unnest(range(1, 21)) AS k) x ON f.lang IN (SELECT lang FROM cw) LEFT JOIN hit ON hit.doc_id = f.doc_id AND hit.k = x.k
            UNION ALL
            SELECT doc_id, lang, base_failed, 0, len(tok) - coalesce((SELECT sum(n) FROM hit WHERE hit.doc_id = f.doc_id), 0) FROM f WHERE lang IN (SELECT lang FROM cw)
        ),
        hc AS (
            SELECT doc_id, lang, base_failed, unnest(range(5)) AS k, unnest(list_append(c, greatest(0, word_chars - list_sum(c)))) AS n FROM f
        ),
        h AS (SELECT 'c' AS kind, * FROM hc UNION ALL SELECT 'w', * FROM hw),
        ref AS (
            SELECT kind, lang, k, sum(n) AS n FROM h WHERE NOT base_failed AND lang IN (SELECT lang FROM f WHERE NOT base_failed GROUP BY lang HAVING count(*) >= 20) GROUP BY kind, lang, k
        ),
        z AS (
            SELECT h.kind, doc_id, h.n / sum(h.n) OVER o AS x, ref.n / sum(ref.n) OVER o AS y, sum(h.n) OVER o AS sx, sum(ref.n) OVER o AS sy
            FROM h JOIN ref USING (kind, lang, k) WINDOW o AS (PARTITION BY h.kind, doc_id)
        ),
        js AS (
            SELECT kind, doc_id, sqrt(greatest(0, sum(CASE WHEN x > 0 THEN x * log2(2 * x / (x + y)) ELSE 0 END + CASE WHEN y > 0 THEN y * log2(2 * y / (x + y)) ELSE 0 END) / 2)) AS dist
            FROM z WHERE sx > 0 AND sy > 0 GROUP BY kind, doc_id
        ),
        v AS (
            SELECT f.*, CASE WHEN word_chars >= 200 THEN jc.dist END AS cd, CASE WHEN n_words >= 60 THEN jw.dist END AS wd
            FROM f LEFT JOIN js jc ON jc.doc_id = f.doc_id AND jc.kind = 'c' LEFT JOIN js jw ON jw.doc_id = f.doc_id AND jw.kind = 'w'
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(cd, 6) + 0.0 AS char_distance, round(wd, 6) + 0.0 AS word_distance,
               NOT base_failed AND coalesce(cd, 0) <= 0.33 AND coalesce(wd, 0) <= 0.35 AS kept FROM v
    """,
    "op11_structure_repair": r"""
        WITH RECURSIVE p(i, c, n) AS (
            SELECT i, i, 0 FROM (SELECT unnest(range(256)) AS i)
            UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM p WHERE n < 8
        ),
        tab AS (SELECT list(c ORDER BY i) AS tab FROM p WHERE n = 8),
        b AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM conversations
        ),
        d AS (SELECT b.*, xor(list_reduce(list_prepend(4294967295, bytes), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) % 20 AS fault FROM b, tab),
        r AS (
            SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
                   CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE fault WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
            FROM d WHERE fault <> 0
        ),
        o AS (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, left(role, 1) AS k1, lead(left(role, 1)) OVER w AS k2,
                     NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') AS cut_off
              FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role)::VARCHAR || ':' || role || text), copy)),
        o2 AS (SELECT *, blank OR again AS must_go, NOT blank AND NOT again AND cut_off AS truncated FROM o),
        m AS (
            SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate,
                   count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE k2 IS NOT NULL AND k1 || k2 NOT IN ('su', 'ua', 'au')) AS illegal
            FROM o2 GROUP BY conv_id
        ),
        fill(q, mid, ins, said) AS (
            VALUES (0, 0, '', ''), (0, 2, 'I', 'user:' || chr(10)), (0, 3, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 1, '', ''), (1, 2, 'I', 'user:' || chr(10)), (1, 3, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)),
                   (2, 2, '', ''), (2, 3, 'I', 'assistant:' || chr(10)), (2, 2, 'II', 'assistant:' || chr(10) || 'user:' || chr(10)), (3, 3, '', ''), (3, 2, 'I', 'user:' || chr(10)), (3, 3, 'II', 'user:' || chr(10) || 'assistant:' || chr(10))
        ),
        op(mid, letter, kind, nxt, price) AS (
            VALUES (0, 'D', NULL, 0, 4), (1, 'D', NULL, 1, 4), (2, 'D', NULL, 2, 4), (3, 'D', NULL, 3, 4), (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (3, 'K', 'u', 2, 0),
                   (0, 'R', NULL, 2, 3), (1, 'R', NULL, 2, 3), (2, 'R', NULL, 3, 3), (3, 'R', NULL, 2, 3)
        ),
        step AS (
            SELECT q, op.nxt, kind, letter, ins || letter AS letters, said, price + 3 * length(ins) AS price FROM fill JOIN op USING (mid)
        ),
        s(conv_id, k, q, best) AS (
            SELECT conv_id, 0, 0, {'c': 0, 'a': '', 't': ''} FROM m
            UNION ALL
            SELECT s.conv_id, s.k + 1, step.nxt, min({'c': best.c + price + CASE WHEN letter <> 'D' AND truncated THEN 3 ELSE 0 END, 'a': best.a || letters,
                   't': best.t || said || CASE letter WHEN 'D' THEN '' WHEN 'K' THEN role || ':' || text || chr(10) WHEN 'R' THEN CASE step.nxt WHEN 2 THEN 'user:' ELSE 'assistant:' END || text || chr(10) END})
            FROM s JOIN o2 ON o2.conv_id IS NOT DISTINCT FROM s.conv_id AND o2.i = s.k + 1 JOIN step ON step.q = s.q AND (letter = 'D' OR NOT must_go AND (kind IS NULL OR kind = k1))
            GROUP BY s.conv_id, s.k, step.nxt
        ),
        done AS (
            SELECT s.conv_id, min({'c': best.c + 3 * length(e.ins), 'a': best.a || e.ins, 't': best.t || e.said}) AS best
            FROM s JOIN m ON m.conv_id IS NOT DISTINCT FROM s.conv_id AND m.n = s.k
            JOIN (VALUES (0, '', ''), (1, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (2, 'I', 'assistant:' || chr(10)), (3, '', '')) e(q, ins, said) ON e.q = s.q GROUP BY s.conv_id, m.n
        )
        SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
               coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(left(best.t, length(best.t) - 1), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM a.conv_id
    """,
    "op12_hard_negatives": """
        WITH e AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        s AS (
            SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
        ),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
    """,
    "op2_sharding": r"""
        WITH RECURSIVE p(i, c, n) AS (
            SELECT i, i, 0 FROM (SELECT unnest(range(256)) AS i)
            UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM p WHERE n < 8
        ),
        tab AS (SELECT list(c ORDER BY i) AS tab FROM p WHERE n = 8),
        d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        b AS (SELECT doc_id, octet_length(encode(t))::BIGINT + 1 AS size, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM d),
        c AS (
            SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, bytes), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b, tab
        ),
        u AS (
            SELECT c.*, i, -1.0 / ln((('0x' || substr(md5(doc_id::VARCHAR || ':' || i::VARCHAR), 1, 13))::BIGINT + 0.5) / 4503599627370496) AS score FROM c, (SELECT unnest(range(9)) AS i)
        ),
        s AS (
            SELECT doc_id, any_value(size) AS size, any_value(text_crc32) AS text_crc32, (arg_max(i, score) FILTER (WHERE i < 8))::INT AS shard, arg_max(i, score)::INT AS grown_shard FROM u GROUP BY doc_id
        ),
        o AS (SELECT *, floor((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || text_crc32::VARCHAR), 1, 13))::BIGINT + 0.5) / 4503599627370496 * 512) AS block FROM s)
        SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY block, doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM o
    """,
}
