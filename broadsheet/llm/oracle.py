"""DuckDB twins of the llm queries that SQL can express; the others are tested against brute force in tests/llm."""

from __future__ import annotations

#: Letters and what else counts as part of a word: all but decimal digits.
WORDS = r"regexp_extract_all(lower(content), '[\p{L}\p{Nl}\p{No}]+')"

TWINS = {
    "p1_statistics": rf"""SELECT DISTINCT id, CAST(len(w) AS BIGINT) AS word_count, round(CASE WHEN len(w) > 0 THEN length(array_to_string(w, '')) / len(w) ELSE 0 END, 6) AS mean_word_length,
 round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: list_contains(c, x))) / len(w) ELSE 0 END, 6) AS common_ratio
 FROM (SELECT id, {WORDS} AS w, (SELECT list(DISTINCT lower(word)) FROM common_words) AS c FROM articles WHERE regexp_matches(content, '[^\s\p{{Z}}\x{{85}}\x1c-\x1f]'))""",
    "p6_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p7_coverage": "SELECT container_kind, (SELECT count(*) FROM documents WHERE text <> '') AS docs, 0 AS cut_in_vain, 0 AS overfull FROM (SELECT DISTINCT container_kind FROM containers WHERE capacity_tokens > 0)",
}


def oracle_sql() -> dict[str, str]:
    return dict(TWINS)
