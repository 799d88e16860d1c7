"""The registered queries of this subpackage, with DuckDB SQL where SQL expresses them."""

from __future__ import annotations

from foliospark.llm import alignment, decontaminate, divergence, jaccard, licences, media, packing, pages, setsketch, sharding, suffixes, token_files, toxicity
from foliospark.llm.licences import THRESHOLD, all_templates, template_bigrams


def _licence_sql() -> str:
    known = ", ".join("{'id': '%s', 'n': %d, 'bigrams': [%s]}" % (i, len(b), ", ".join(f"'{x}'" for x in b)) for i, t in all_templates() if (b := template_bigrams(t)))
    return rf"""
WITH normal AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\n]+', ' ', 'g') AS t FROM documents),
paragraphs AS (SELECT doc_id, t, regexp_split_to_array(t, '\n *\n') AS p FROM normal),
units AS (SELECT doc_id, list_concat(string_split(t, chr(10)),
    list_transform(list_filter(p, lambda x: contains(x, chr(10))), lambda x: replace(x, chr(10), ' ')),
    CASE WHEN len(p) > 1 THEN [replace(t, chr(10), ' ')] ELSE [] END) AS u FROM paragraphs),
words AS (SELECT doc_id, list_filter(list_transform(u, lambda x: list_filter(string_split(x, ' '), lambda w: w <> '')), lambda w: len(w) > 1) AS w FROM units),
bigrams AS (SELECT doc_id, list_transform(w, lambda x: list_distinct(list_transform(range(1, len(x)), lambda i: x[i] || ' ' || x[i + 1]))) AS b FROM words),
pairs AS (SELECT row_number() OVER () AS unit, doc_id, b FROM (SELECT doc_id, unnest(b) AS b FROM bigrams)),
hits AS (SELECT unit, doc_id, k.id AS id, 2.0::DOUBLE * len(list_intersect(b, k.bigrams)) / (len(b) + k.n) AS dice
    FROM pairs, (SELECT unnest([{known}]) AS k) WHERE 2.0 * least(len(b), k.n) >= {THRESHOLD}::DOUBLE * (len(b) + k.n)),
likest AS (SELECT * FROM hits WHERE dice >= {THRESHOLD}::DOUBLE QUALIFY dice = max(dice) OVER (PARTITION BY unit)),
kept AS (SELECT doc_id, id, dice, max(dice) OVER (PARTITION BY doc_id) AS best FROM likest),
found AS (SELECT doc_id, count(*) AS n_matches, array_to_string(list_sort(list(DISTINCT id)), ',') AS license_ids,
    min(CASE WHEN dice = best THEN id END) AS best_license, round(max(dice), 6) AS best_dice FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_matches, 0)::BIGINT AS n_matches, coalesce(license_ids, '') AS license_ids, best_license, best_dice, n_matches IS NOT NULL AS licensed
FROM documents d LEFT JOIN found USING (doc_id)"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_CONTAMINATION_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS t FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p))),
h AS (SELECT doc_id, i, s.n, item_id FROM s JOIN p ON s.t = p.t AND s.n = p.n),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY 1),
l AS (SELECT doc_id, count(x) AS n_items, string_agg(x, ',' ORDER BY x) AS listed FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)"""

_JACCARD_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^ \t-\r]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""


_NEAR_SQL = f"SELECT *, doc_id = component_id AS kept FROM ({_JACCARD_SQL.replace('>= 85 *', '>= 80 *')})"


def queries() -> dict:
    return {
        "op1_page_differencing": pages.op1_page_differencing,
        "op2_repair_tokens": token_files.op2_repair_tokens,
        "op3_suffix_merge": suffixes.op3_suffix_merge,
        "op4_rendezvous_shards": sharding.op4_rendezvous_shards,
        "op5_wu_manber": decontaminate.op5_wu_manber,
        "op6_weak_toxicity": toxicity.op6_weak_toxicity,
        "op7_best_fit_packing": packing.op7_best_fit_packing,
        "op8_size_aware_jaccard": jaccard.op8_size_aware_jaccard,
        "op9_interleaved_media": media.op9_interleaved_media,
        "op10_licence_dice": licences.op10_licence_dice,
        "op11_cross_tokenizer_alignment": alignment.op11_cross_tokenizer_alignment,
        "op12_setsketch_near_dedup": setsketch.op12_setsketch_near_dedup,
        "op13_source_divergence": divergence.op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_wu_manber": _CONTAMINATION_SQL, "op8_size_aware_jaccard": _JACCARD_SQL, "op10_licence_dice": _licence_sql(), "op12_setsketch_near_dedup": _NEAR_SQL, "op13_source_divergence": divergence.SQL}
