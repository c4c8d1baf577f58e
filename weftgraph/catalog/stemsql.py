"""The published Porter2 rules as DuckDB SQL over a table of distinct terms, to check the stems of Spark's expressions."""

from __future__ import annotations

from ..functions import stems as S


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _cut(n: str | int) -> str:
    return f"left(w, greatest(length(w) - {n}, 0))"


def _chosen(value: str, rules: dict[str, str]) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in rules.items()) + " END"


def _parted(pattern: str) -> list[str]:
    return [f"SELECT * EXCLUDE (s, head), regexp_extract(w, '({pattern})$', 1) AS s FROM {{}}", f"SELECT *, {_cut('length(s)')} AS head FROM {{}}"]


def _step(rules: dict[str, str], region: str) -> list[str]:
    before = "".join(f" AND (s <> '{x}' OR regexp_matches(head, '[{S.BEFORE[x]}]$'))" for x in sorted(S.BEFORE.keys() & rules.keys()))
    fits = f"s <> '' AND length(head) >= CASE WHEN s IN ({_quoted(S.IN_SECOND)}) THEN p2 ELSE {region} END{before}"
    return [*_parted("|".join(rules)), f"SELECT * REPLACE (CASE WHEN {fits} THEN head || {_chosen('s', rules)} ELSE w END AS w) FROM {{}}"]


def stem_sql(source: str, name: str = "stems") -> str:
    """CTEs of which the last, ``name``, is (term, stem) of the distinct terms of ``source(term)``."""
    vowel, short = f"[{S.VOWELS}]", S.SHORT
    region = f"length(regexp_extract({{}}, '^({{}}{S.REGION})', 0))"
    first, second = region.format("w", S.FIRST_REGION + "|"), region.format("substr(w, p1 + 1)", "")
    mended = (
        f"CASE WHEN regexp_matches(w, '(at|bl|iz)$') OR short AND NOT regexp_matches(w, '({S.DOUBLES})$') THEN w || 'e' "
        f"WHEN regexp_matches(w, '({S.DOUBLES})$') THEN {_cut(1)} ELSE w END"
    )
    plural = f"WHEN s = 'sses' THEN {_cut(2)} WHEN s IN ('ied', 'ies') THEN CASE WHEN length(w) > 4 THEN {_cut(2)} ELSE {_cut(1)} END"
    steps = [
        f"SELECT term, regexp_replace(regexp_replace(regexp_replace(term, '^''', ''), '^y', 'Y'), '({vowel})y', '\\1Y', 'g') AS w, '' AS s, '' AS head FROM (SELECT DISTINCT term FROM {{}})",
        f"SELECT *, CASE WHEN {first} > 0 THEN {first} ELSE length(w) END AS p1 FROM {{}}",
        f"SELECT *, CASE WHEN {second} > 0 THEN p1 + {second} ELSE length(w) END AS p2 FROM {{}}",
        "SELECT * REPLACE (regexp_replace(w, '(''s''|''s|'')$', '') AS w) FROM {}",
        *_parted("sses|ied|ies|us|ss|s"),
        f"SELECT * REPLACE (CASE {plural} WHEN s = 's' AND regexp_matches({_cut(2)}, '{vowel}') THEN {_cut(1)} ELSE w END AS w) FROM {{}}",
        f"SELECT *, CASE WHEN w IN ({_quoted(S.AFTER_PLURAL)}) THEN w END AS kept FROM {{}}",
        *_parted("eedly|ingly|edly|eed|ing|ed"),
        f"SELECT *, s <> '' AND s NOT IN ('eed', 'eedly') AND regexp_matches(head, '{vowel}') AS cut FROM {{}}",
        "SELECT * REPLACE (CASE WHEN cut THEN head WHEN s IN ('eed', 'eedly') AND length(head) >= p1 THEN head || 'ee' ELSE w END AS w) FROM {}",
        f"SELECT *, p1 >= length(w) AND regexp_matches(w, '{short}') AS short FROM {{}}",
        f"SELECT * REPLACE (CASE WHEN cut THEN {mended} ELSE w END AS w) FROM {{}}",
        "SELECT * REPLACE (regexp_replace(w, '^(.+[^aeiouy])[yY]$', '\\1i') AS w) FROM {}",
        *_step(S.STEP_2, "p1"),
        *_step(S.STEP_3, "p1"),
        *_step(S.STEP_4, "p2"),
        f"SELECT * REPLACE (CASE WHEN w LIKE '%ll' AND length(w) > p2 OR w LIKE '%e' AND (length(w) > p2 OR length(w) > p1 AND NOT regexp_matches({_cut(1)}, '{short}')) THEN {_cut(1)} ELSE w END AS w) FROM {{}}",
    ]
    ctes = []
    for n, step in enumerate(steps):
        ctes.append(f"{name}_{n} AS ({step.format(f'{name}_{n - 1}' if n else source)})")
    last = f"coalesce({_chosen('term', S.SPECIAL)}, CASE WHEN length(term) <= 2 THEN term END, kept, lower(w))"
    return ", ".join(ctes) + f", {name} AS MATERIALIZED (SELECT term, {last} AS stem FROM {name}_{len(steps) - 1})"
