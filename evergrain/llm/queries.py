"""The queries of this subpackage, with production parameters, over whole tables; and their SQL where there is one."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, dialogue, impact, jaccard, langid, lattice, licences, mainpage, mixture, quantise, urls, warc


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer("piece_bpe_32k.model"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, percent=85)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe.encode(docs, tokenizer("byte_bpe_50k.tiktoken"), pattern(), with_ids=False)


def op6_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantise.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_mainpage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainpage.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: The rules of op11: host and path prefix, verdict.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair(dialogue.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op11 that SQL can express; the verdict where a rule gives it."""
    return op11_urls(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


def lm_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1 that SQL can express."""
    got = op1_lattice(spark, sf_dir)
    return got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4 that SQL can express."""
    return op4_mixture(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lattice": op1_lattice,
    "op2_jaccard": op2_jaccard,
    "op3_langid": op3_langid,
    "op4_mixture": op4_mixture,
    "op5_bpe": op5_bpe,
    "op6_quantise": op6_quantise,
    "op7_impact": op7_impact,
    "op8_licences": op8_licences,
    "op9_mainpage": op9_mainpage,
    "op10_warc": op10_warc,
    "op11_urls": op11_urls,
    "op12_audit": op12_audit,
    "op13_dialogue": op13_dialogue,
    "url_rules": url_rules,
    "lm_counts": lm_counts,
    "mix_targets": mix_targets,
}

_CRC32 = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
            lambda c, b: list_reduce(list_prepend(xor(c, b), [1, 2, 3, 4, 5, 6, 7, 8]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLE: dict[str, str] = {
    "op2_jaccard": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM w JOIN r ON r.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id
    """,
    "op6_quantise": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
        good AS (SELECT * FROM v WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
        e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.98),
        r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), l AS (SELECT a, count(*) AS n FROM e GROUP BY a)
        SELECT vec_id, coalesce(l.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.a = vec_id LEFT JOIN l ON l.a = vec_id
    """,
    "op7_impact": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id AND len(q.x) = len(v.x)),
        t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
        SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM t WHERE k <= 5
    """,
    "lm_counts": f"""
        WITH d AS (SELECT doc_id, {_CRC32} % 7 = 2 AS held_out, list_append({_WORDS}, '') AS w FROM documents),
        t AS (SELECT doc_id, held_out, unnest(w) AS word FROM d), c AS (SELECT word, count(*) AS c FROM t WHERE NOT held_out GROUP BY word),
        s AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c)
        SELECT doc_id, held_out, count(*) AS n_tokens, count(c.c) AS n_known, any_value(s.n) AS train_tokens, round(sum(log10((coalesce(c.c, 0) + 1) / CAST(s.n + s.v + 1 AS DOUBLE))), 6) AS base_score
        FROM t LEFT JOIN c ON t.word = c.word CROSS JOIN s GROUP BY doc_id, held_out
    """,
    "mix_targets": f"""
        WITH RECURSIVE d AS (SELECT doc_id, source, len({_WORDS}) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
        f AS (SELECT source, n, w, 0 AS step, FALSE AS fixed FROM s
            UNION ALL SELECT source, n, w, step + 1, fixed OR total * w / weight > 3 * n FROM (
                SELECT *, (SELECT sum(n) FROM s) - sum(CASE WHEN fixed THEN 3 * n ELSE 0 END) OVER () AS total, CAST(sum(CASE WHEN fixed THEN 0 ELSE w END) OVER () AS DOUBLE) AS weight FROM f) WHERE step < 50),
        z AS (SELECT *, (SELECT sum(n) FROM s) - sum(CASE WHEN fixed THEN 3 * n ELSE 0 END) OVER () AS total, CAST(sum(CASE WHEN fixed THEN 0 ELSE w END) OVER () AS DOUBLE) AS weight FROM f WHERE step = 50)
        SELECT doc_id, size, z.n AS source_size, round(CASE WHEN fixed THEN 3.0 * z.n ELSE total * w / weight END, 6) AS target FROM d JOIN z ON d.source IS NOT DISTINCT FROM z.source
    """,
    "op10_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages
        ), w AS (
            SELECT html, max(page_id) AS winner FROM p WHERE payload_bytes >= 1000 GROUP BY html
        )
        SELECT p.page_id, p.payload_bytes, sha1(p.html) AS payload_digest,
            CASE WHEN p.page_id <> w.winner THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN p.page_id <> w.winner THEN w.winner END AS refers_to
        FROM p LEFT JOIN w ON p.html = w.html
    """,
    "url_rules": r"""
        WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
        r AS (SELECT * FROM (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')) t(rule, h, pre, ruled)),
        m AS (SELECT page_id, p.host, p.path, r.rule, r.ruled, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC, r.rule) AS k
            FROM p LEFT JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.pre))
        SELECT page_id, host, path, rule, ruled FROM m WHERE k = 1
    """,
    "op12_audit": r"""
        WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        f AS (SELECT part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t), regexp_matches(t, '[#$%&*|]'),
                coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), FALSE)] AS bad,
                doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic FROM w),
        c AS (SELECT part, bad, good, toxic, count(*) AS n FROM f GROUP BY ALL),
        l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)) t(letter, k)),
        o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS ks, concat(a.letter, b.letter, c.letter, d.letter, e.letter) AS filter_order FROM l a, l b, l c, l d, l e
            WHERE a.k NOT IN (b.k, c.k, d.k, e.k) AND b.k NOT IN (c.k, d.k, e.k) AND c.k NOT IN (d.k, e.k) AND d.k <> e.k),
        s AS (SELECT filter_order, step, ks[step] AS own, ks[:step - 1] AS prior FROM o, range(1, 6) r(step)),
        x AS (SELECT part, filter_order, step, own, n, good, toxic, bad[own] AS fails, len(list_filter(prior, lambda k: bad[k])) > 0 AS gone, len(list_filter(bad, lambda b: b)) AS many FROM c, s),
        g AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, own, CAST(sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
            CAST(sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN fails AND many = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
            CAST(sum(CASE WHEN fails AND NOT gone AND good THEN n ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN fails AND NOT gone AND toxic THEN n ELSE 0 END) AS BIGINT) AS toxic_lost FROM x GROUP BY ALL)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM g
    """,
    "op13_dialogue": r"""
        WITH o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, CRC % 20 AS d FROM conversations),
        x AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM o, range(2) t(copy) WHERE d <> 0 AND (copy = 0 OR d = 3)),
        n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM x),
        f AS (SELECT *, role[1] AS i, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY k) AS j, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
            WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM n),
        g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
            count(*) FILTER (k > 1 AND i || j IS DISTINCT FROM 'us' AND i || j IS DISTINCT FROM 'au' AND i || j IS DISTINCT FROM 'ua') AS illegal, list([i, fault] ORDER BY k) AS rows FROM f GROUP BY conv_id),
        -- cost and audit of what is expected next: Talk, Open, Reply, More
        b AS (SELECT *, list_reduce(list_prepend(['000000000', '999000000', '999000000', '999000000'], list_append(rows, ['', 'end'])), lambda s, r: list_transform([[s[1], s[2],
                least(s[3], ADD(s[1], 3, 'I'), ADD(s[2], 3, 'I'), ADD(s[4], 3, 'I')), least(s[4], ADD(s[3], 3, 'I'), ADD(s[1], 6, 'II'), ADD(s[2], 6, 'II'))]],
            lambda z: CASE WHEN r[2] = 'end' THEN z WHEN r[2] IN ('blank', 'duplicate') THEN list_transform(z, lambda y: ADD(y, 4, 'D')) ELSE [ADD(z[1], 4, 'D'),
                least(ADD(z[2], 4, 'D'), CASE WHEN r[1] = 's' THEN ADD(z[1], LATE, 'K') ELSE '999000000' END),
                least(ADD(z[3], 4, 'D'), CASE WHEN r[1] = 'u' THEN ADD(least(z[1], z[2], z[4]), LATE, 'K') ELSE ADD(least(z[1], z[2], z[4]), 3 + LATE, 'R') END),
                least(ADD(z[4], 4, 'D'), CASE WHEN r[1] = 'a' THEN ADD(z[3], LATE, 'K') ELSE ADD(z[3], 3 + LATE, 'R') END)] END)[1]) AS chart FROM g),
        a AS (SELECT *, CAST(least(chart[1], chart[4])[:9] AS BIGINT) AS cost, least(chart[1], chart[4])[10:] AS audit FROM b),
        e AS (SELECT conv_id, unnest(string_split(audit, '')) AS edit, unnest(range(1, length(audit) + 1)) AS pos FROM a WHERE audit <> ''),
        p AS (SELECT *, sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER w AS k, sum(CASE WHEN edit <> 'D' THEN 1 ELSE 0 END) OVER w AS m FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
        q AS (SELECT p.*, f.role, f.text, bool_or(p.edit = 'K' AND p.m = 1 AND f.i = 's') OVER (PARTITION BY p.conv_id) AS led FROM p LEFT JOIN f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND p.k = f.k AND p.edit <> 'I'),
        t AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (m - CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS done FROM q WHERE edit <> 'D' GROUP BY conv_id)
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
            coalesce(audit, '') AS audit, sha256(coalesce(done, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM o) c LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
    """,
}

#: ADD(x, cost, edits) puts a cost and edits on a state: nine digits of cost, then the audit.
ORACLE["op13_dialogue"] = re.sub(r"ADD\(((?:[^()]|\([^()]*\))*?), ([^,()]+), ('[A-Z]+')\)", r"(lpad(CAST(CAST((\1)[:9] AS BIGINT) + \2 AS VARCHAR), 9, '0') || (\1)[10:] || \3)", ORACLE["op13_dialogue"])
ORACLE["op13_dialogue"] = ORACLE["op13_dialogue"].replace("LATE", "(CASE WHEN r[2] = 'truncated' THEN 3 ELSE 0 END)")
ORACLE["op13_dialogue"] = ORACLE["op13_dialogue"].replace("CRC", _CRC32.replace("CAST(doc_id AS VARCHAR)", "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"))
