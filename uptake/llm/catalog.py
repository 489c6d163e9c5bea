"""Queries over the given tables, one for each operator, and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (exact_dedup, filter_audit, language_id, license_scan, mixture_packing, near_dedup, packing, phrase_index, suffix_dedup,
               surrogates, toxicity, url_filter, vector_codes)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_counterfactual_toxicity")
def op1_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    scored = toxicity.score(docs, toxicity.fit(docs, labels.filter(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op2_language_mixture")
def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    model = language_id.train(docs.filter(~held_out))
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "languages", "shares")


@query("op3_phrase_index", r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, array_to_string(w[i:least(i + 9, len(w))], ' ') AS phrase, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), grams AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))
), hit AS (
  SELECT doc_id, item_id, i, n FROM grams JOIN win USING (n, phrase)
), per AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1
), ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN ids USING (doc_id)""")
def op3_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def _level(k: int) -> str:
    """SQL of one level of the template tree, whose parent level is p{k - 1}."""
    keys = ["host", "u1", "u2", "u3"]
    own, up = ", ".join(keys[:k]), ", ".join(keys[:k - 1])
    over = f"PARTITION BY {up}" if up else ""
    prior = f"JOIN p{k - 1} USING ({up})" if up else ", p0"
    return f"""n{k} AS (
  SELECT {own}, b, l, purity AS prior, abs(b - l * purity) <= 2 * sqrt(l * purity * (1 - purity)) AS alike
  FROM (SELECT {own}, sum(blocked)::BIGINT AS b, sum(labelled)::BIGINT AS l FROM tree GROUP BY {own}) x {prior}
), p{k} AS (
  SELECT {own}, CASE WHEN alike THEN (sum(b) FILTER (alike) OVER ({over}) + 4.0::DOUBLE * prior) / (sum(l) FILTER (alike) OVER ({over}) + 4.0::DOUBLE)
                ELSE (b + 4.0::DOUBLE * prior) / (l + 4.0::DOUBLE) END AS purity
  FROM n{k}
)"""


def _wide(k: int) -> str:
    """SQL that turns the children of nodes with many rare ones into wildcards."""
    keys = ", ".join(["host", "u1", "u2", "u3"][:k])
    source = "leaves" if k == 1 else f"g{k - 1}"
    return f"""g{k} AS (
  SELECT x.*, CASE WHEN children >= 20 AND visits < 5 * children THEN '*' ELSE t{k} END AS u{k}
  FROM {source} x JOIN (SELECT {keys}, count(DISTINCT t{k}) AS children, sum(pages) AS visits FROM {source} GROUP BY {keys}) USING ({keys})
)"""


_URL_SQL = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages
), r AS (
  SELECT *, CASE
      WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
      WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule,
    list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: regexp_replace(s, '[0-9]+', '{n}', 'g')) AS s
  FROM u
), t AS (
  SELECT *, coalesce(s[1], '') AS t1, coalesce(s[2], '') AS t2, CASE WHEN len(s) > 3 THEN s[3] || '/**' ELSE coalesce(s[3], '') END AS t3 FROM r
), leaves AS (
  SELECT host, t1, t2, t3, count(*) AS pages, count(rule) AS labelled,
         count(*) FILTER (rule IN ('example.org/en/1', 'example.org/es/', 'com/de/')) AS blocked
  FROM t GROUP BY host, t1, t2, t3
), """ + ", ".join(_wide(k) for k in (1, 2, 3)) + """, tree AS (SELECT * FROM g3), p0 AS (
  SELECT (sum(blocked) + 1.0::DOUBLE) / (sum(labelled) + 2.0::DOUBLE) AS purity FROM tree
), """ + ", ".join(_level(k) for k in (1, 2, 3, 4)) + """
SELECT page_id, t.host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN purity >= 0.8 THEN 'block' ELSE 'allow' END AS verdict,
       concat_ws('/', t.host, nullif(u1, ''), nullif(u2, ''), nullif(u3, '')) AS template
FROM t JOIN tree USING (host, t1, t2, t3) JOIN p4 USING (host, u1, u2, u3)"""


@query("op5_suffix_array_dedup")
def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))


@query("op6_url_filter", _URL_SQL)
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).drop("purity")


@query("op7_near_dedup", r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:least(i + 4, len(w))], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
), r(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = doc_id AS kept
FROM (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) LEFT JOIN n USING (doc_id)""")
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op8_surrogates")
def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymise(table(spark, sf_dir, "documents"), key="uptake")


@query("op9_exact_dedup", r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k""")
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(table(spark, sf_dir, "documents"))


_LICENSE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), phrase(words, label) AS (VALUES
  (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')
), place AS (
  SELECT rid, label, i - 1 AS i
  FROM (SELECT rid, w, label, words, unnest(range(1, len(w) - len(words) + 2)) AS i FROM d, phrase)
  WHERE w[i:i + len(words) - 1] = words
), base AS (
  SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM place GROUP BY 1
), template(template, label, marks, body) AS (VALUES
  (0, 'apache', 'apache', 'licensed under the apache license version 2 0'),
  (1, 'apache', 'apache', 'you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses'),
  (2, 'mit', 'mit', 'released under the mit license'),
  (3, 'mit', 'permission granted', 'permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files'),
  (4, 'gpl', 'gnu general public', 'this work is licensed under the gnu general public license version 3'),
  (5, 'gpl', 'gnu general public', 'this program is free software you can redistribute it and or modify it under the terms of the gnu general public license'),
  (6, 'lgpl', 'gnu lesser general public', 'licensed under the gnu lesser general public license version 3'),
  (7, 'lgpl', 'gnu lesser general public', 'this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license'),
  (8, 'agpl', 'gnu affero general public', 'licensed under the gnu affero general public license version 3'),
  (9, 'agpl', 'gnu affero general public', 'this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license'),
  (10, 'bsd', 'redistribution source binary', 'redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met'),
  (11, 'mpl', 'mozilla', 'this source code form is subject to the terms of the mozilla public license v 2 0'),
  (12, 'cc-by', 'cc by', 'licensed under cc by 4 0'),
  (13, 'cc-by-nc', 'cc by nc', 'licensed under cc by nc 4 0'),
  (14, 'cc-by-sa', 'cc by sa', 'licensed under cc by sa 4 0'),
  (15, 'cc-by-nc-sa', 'cc by nc sa', 'licensed under cc by nc sa 4 0'),
  (16, 'cc-by', 'creative commons attribution', 'this work is licensed under a creative commons attribution 4 0 international license'),
  (17, 'cc-by-nc', 'creative commons attribution noncommercial', 'this work is licensed under a creative commons attribution noncommercial 4 0 international license'),
  (18, 'cc-by-sa', 'creative commons attribution sharealike', 'this work is licensed under a creative commons attribution sharealike 4 0 international license'),
  (19, 'cc-by-nc-sa', 'creative commons attribution noncommercial sharealike', 'this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license'),
  (20, 'cc0', 'waived copyright', 'to the extent possible under law the author has waived all copyright and related rights to this work'),
  (21, 'unlicense', 'unencumbered', 'this is free and unencumbered software released into the public domain')
), shape AS (
  SELECT template, label, string_split(marks, ' ') AS marks, string_split(body, ' ') AS body, list_distinct(string_split(body, ' ')) AS words FROM template
), rival AS (
  SELECT t.template, list(DISTINCT m) AS rivals
  FROM shape t, (SELECT marks, unnest(marks) AS m FROM shape) u
  WHERE list_has_all(u.marks, t.marks) AND len(u.marks) > len(t.marks) AND NOT list_contains(t.words, m) GROUP BY 1
), sets AS (
  SELECT template, label, marks, words, coalesce(rivals, []) AS rivals, CAST(ceil(len(words) * 0.8 - 1e-9) AS BIGINT) AS need, CAST(ceil(len(body) / 0.8 - 1e-9) AS BIGINT) AS run
  FROM shape LEFT JOIN rival USING (template)
), start AS (
  SELECT rid, w, s.*, unnest([i for i in range(1, len(w) + 1) if list_contains(words, w[i])]) AS i FROM d, sets s WHERE list_has_all(w, marks)
), run AS (
  SELECT *, w[i:coalesce(list_min([k for k in range(i, i + run) if list_contains(rivals, w[k])]), i + run) - 1] AS held FROM start
), found AS (
  SELECT rid, template, label, len(list_intersect(list_distinct(held), words)) / len(words) AS containment
  FROM run WHERE list_has_all(held, marks) AND len(list_intersect(list_distinct(held), words)) >= need
), per AS (
  SELECT rid, max(containment) AS best, count(DISTINCT template) AS n_templates FROM found GROUP BY 1
), l0 AS (
  SELECT rid, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT rid, label FROM place) GROUP BY 1
), l1 AS (
  SELECT rid, string_agg(label, ',' ORDER BY label) AS labels
  FROM (SELECT rid, label FROM place UNION SELECT rid, label FROM found) GROUP BY 1
)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS score, coalesce(n_templates, 0) AS n_templates
FROM d LEFT JOIN base USING (rid) LEFT JOIN per USING (rid) LEFT JOIN l0 USING (rid) LEFT JOIN l1 USING (rid)"""


@query("op10_license_scan", _LICENSE_SQL)
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("n_lines")


@query("op11_mixture_packing")
def op11_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_packing.pack(table(spark, sf_dir, "documents"))


_AUDIT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d
), f AS (
  SELECT doc_id, part, CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
       + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
       + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask
  FROM w
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY 1
), c AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2
), x(k) AS (VALUES (0), (1), (2), (3), (4)
), o AS (
  SELECT list_value(a.k, b.k, c.k, d.k, e.k) AS o FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct(list_value(a.k, b.k, c.k, d.k, e.k))) = 5
), s AS (
  SELECT list_aggregate(list_transform(o, lambda k: chr(65 + k)), 'string_agg', '') AS filter_order, CAST(i AS INT) AS step, 1 << o[i] AS bit,
         CAST(coalesce(list_sum(list_transform(o[1:i - 1], lambda k: 1 << k)), 0) AS INT) AS before
  FROM o, (SELECT unnest(range(1, 6)) AS i)
), p AS (
  SELECT part, filter_order, step, bit,
         CAST(sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM s, c GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM p"""


@query("op12_filter_audit", _AUDIT_SQL)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _assigned(k: int) -> str:
    """SQL of the nearest entries of codebook b{k}."""
    far = " + ".join(f"(p.x{d} - e.x{d}) * (p.x{d} - e.x{d})" for d in range(4))
    return f"""a{k} AS (
  SELECT vec_id, part, label, p.x0, p.x1, p.x2, p.x3, min(({far}) * 64 + entry) % 64 AS entry, min({far}) AS far
  FROM p JOIN b{k} e USING (part) GROUP BY ALL
)"""


def _averaged(k: int) -> str:
    """SQL of the codebook after round k + 1."""
    means = ", ".join(f"coalesce(CAST(floor(sum(a.x{d}) / count(a.vec_id)) AS BIGINT), any_value(e.x{d})) AS x{d}" for d in range(4))
    return f"""b{k + 1} AS (
  SELECT part, entry, {means} FROM b{k} e LEFT JOIN a{k} a USING (part, entry) GROUP BY part, entry
)"""


_VECTOR_SQL = """
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), p AS (
  SELECT vec_id, label, k AS part, c[4 * k + 1] AS x0, c[4 * k + 2] AS x1, c[4 * k + 3] AS x2, c[4 * k + 4] AS x3
  FROM v, (SELECT unnest(range(16)) AS k)
), b0 AS (
  SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, x0, x1, x2, x3
  FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)
), """ + ", ".join([_assigned(0), _averaged(0), _assigned(1), _averaged(1), _assigned(2)]) + """, r AS (
  SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a2 GROUP BY 1, 2
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(concat_ws(',', x0, x1, x2, x3), ',' ORDER BY part, entry)) FROM b2) AS codebooks_sha256
FROM r"""


@query("op13_vector_codes", _VECTOR_SQL)
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.fingerprint(books)).alias("codebooks_sha256"))
