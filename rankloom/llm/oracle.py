"""What SQL can say of the queries: the same rows for DuckDB, by plain joins and windows."""

from __future__ import annotations

from rankloom.llm.decontamination import WINDOW as PHRASE
from rankloom.llm.substrings import WINDOW
from rankloom.llm.url_cascade import BLOCK_WORDS, RULES

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def contamination() -> str:
    words = f"regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
i AS (SELECT item_id, {words} AS w FROM benchmark),
phrases AS (SELECT DISTINCT item_id, least(len(w), {PHRASE}) AS size, array_to_string(w[s:s + {PHRASE} - 1], ' ') AS phrase
            FROM i, unnest(range(1, greatest(len(w) - {PHRASE} + 1, 1) + 1)) AS u(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM phrases),
places AS (SELECT doc_id, s, size, array_to_string(w[s:s + size - 1], ' ') AS phrase
           FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS u(s)),
found AS (SELECT p.doc_id, p.s, p.size, q.item_id FROM places p JOIN phrases q USING (size, phrase)),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS pos FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""


def dedup() -> str:
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, s, array_to_string(w[s:s + {WINDOW} - 1], ' ') AS words FROM d, unnest(range(1, len(w) - {WINDOW} + 2)) AS u(s)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY words ORDER BY doc_id, s) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + {WINDOW})) AS pos FROM later),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


def urls() -> str:
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in rules]
    rule = " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, rules))
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, rules))
    words = ", ".join(f"'{w}'" for w in BLOCK_WORDS)
    return f"""
WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, {LOWER.format("regexp_extract(rest, '^[^/?#]*', 0)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {verdict} WHEN list_has_any(string_split(replace(host, '-', '.'), '.'), [{words}]) THEN 'block' ELSE 'allow' END AS verdict
FROM parts"""


def hard_negatives() -> str:
    return """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS whole
           FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.whole, b.whole)::BIGINT AS score
          FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT * FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id, row_number() OVER best::INTEGER AS rank, n.other_id AS negative_id,
       p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 100 * n.score BETWEEN 50 * p.score AND 95 * p.score
WINDOW best AS (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id)
QUALIFY row_number() OVER best <= 3"""


SQL = {"op11_hard_negatives": hard_negatives(), "op5_decontamination": contamination(), "op7_substrings": dedup(), "op8_url_cascade": urls()}
