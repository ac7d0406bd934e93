"""The queries of this subpackage and, where SQL can express them, the same in SQL."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

from .collocations import OP13_SQL, op13_collocations
from .exact_dedup import OP5_SQL, op5_exact_dedup
from .link_graph import OP11_SQL, op11_url_filter
from .mixing import op1_mix_sources
from .near_dedup import op7_near_dedup
from .packing import op3_pack_sequences
from .page_text import op8_page_text
from .personal import op9_personal_data
from .quality import op6_quality_rules
from .secret_scan import op2_secret_scan
from .suffix_tree import op10_lm_score
from .token_counts import op4_token_counts
from .vector_codes import OP12_SQL, op12_vector_codes

# What tasks run travels with them, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_secret_scan": op2_secret_scan,
    "op3_pack_sequences": op3_pack_sequences,
    "op4_token_counts": op4_token_counts,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_near_dedup": op7_near_dedup,
    "op8_page_text": op8_page_text,
    "op9_personal_data": op9_personal_data,
    "op10_lm_score": op10_lm_score,
    "op11_url_filter": op11_url_filter,
    "op12_vector_codes": op12_vector_codes,
    "op13_collocations": op13_collocations,
}
ORACLE_SQL = {"op5_exact_dedup": OP5_SQL, "op11_url_filter": OP11_SQL, "op12_vector_codes": OP12_SQL, "op13_collocations": OP13_SQL}


def columns(name: str, *picked: str):
    """A query for some columns of an operator's result, those that SQL can express."""
    return lambda spark, sf_dir: QUERIES[name](spark, sf_dir).select(*picked)


QUERIES |= {
    "mixing_sizes": columns("op1_mix_sources", "doc_id", "size", "source_size"),
    "secret_base_counts": columns("op2_secret_scan", "doc_id", "n_assign", "n_access", "n_hex"),
    "quality_base_columns": columns("op6_quality_rules", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"),
    "personal_base_counts": columns("op9_personal_data", "doc_id", "n_email", "n_ip", "n_card", "n_phone"),
}
SPACE, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
ORACLE_SQL |= {
    "mixing_sizes": rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}+')) AS size FROM documents)
SELECT doc_id, size, cast(sum(size) OVER (PARTITION BY source) AS bigint) AS source_size FROM d
""",
    "secret_base_counts": r"""
SELECT doc_id, len(list_filter(regexp_extract_all(t, '(?:(?i)password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 6)) AS n_assign,
  len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
""",
    "quality_base_columns": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}+') AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM documents),
windows AS (SELECT doc_id, i, list_slice(ws, i, i + 4) AS five FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, five) > 1),
held AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2), (3), (4)) AS s(k) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, length(regexp_replace(t, '{SPACE}+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(n, 0) AS n_repeat_words, len(ws) < 10 OR 100 * coalesce(n, 0) > 20 * len(ws) AS base_failed FROM d LEFT JOIN held ON held.doc_id = d.doc_id
""",
    "personal_base_counts": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), digits AS (
  SELECT doc_id, t, list_filter(list_transform(regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda x: length(x) BETWEEN 12 AND 19) AS cards FROM d)
SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS n_email,
  len(list_filter(regexp_extract_all(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), lambda x: len(list_filter(string_split(x, '.'), lambda p: coalesce(try_cast(p AS hugeint), 999) > 255)) = 0)) AS n_ip,
  len(list_filter(cards, lambda x: list_sum(list_transform(range(length(x)), lambda i: CASE WHEN i % 2 = 0 THEN cast(x[length(x) - i] AS int) ELSE 2 * cast(x[length(x) - i] AS int) // 10 + 2 * cast(x[length(x) - i] AS int) % 10 END)) % 10 = 0)) AS n_card,
  len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 9 AND 15)) AS n_phone
FROM digits
""",
}
