"""What is taken out of texts: paths, errors, ids, literals with their labels, and the engine's own blocks, as rules."""

from __future__ import annotations

#: From command: the first four path spellings of a shell command, and the same without a leading ``./`` or project.
SHELL_PATHS = [
    {"tokens": r"transform(regexp_extract_all(command, r'((?:\x27[^\x27]*\x27|\x22[^\x22]*\x22|[^\s\x27\x22])+)', 1), x -> replace_all(replace_all(x, r'[\x27\x22]', ''), r'[;:,)\x22\x27]+$', ''))"},
    {"paths": r"filter(tokens, x -> instr(x, '/') > 0 AND instr(x, '://') = 0 AND substring(x, 1, 1) <> '-' AND NOT regexp_like(x, r'[<>]') AND length(x) <= 256 AND NOT regexp_like(x, r'^/dev(/|$)'))"},
    {"first": "first_distinct(paths)"},
    {"spellings": "array_join(head(first, 4), ' ')", "normal": r"array_join(transform(head(first, 4), x -> replace_all(x, r'^(/home/[^/]+/[^/]+/|[.]/)', '')), ' ')"},
]

#: From text: error signatures, distinct and sorted, at most twelve.
ERRORS = [
    {"lines": r"filter(transform(head(string_lines(text), 400), x -> trim(x)), x -> length(x) BETWEEN 1 AND 1000)"},
    {
        "typed": r"transform(lines, x -> regexp_extract(x, r'\b((?:[A-Z][A-Za-z0-9]*(?:Error|Exception)|E[A-Z]{2,})\b(?::\s*[^\n]+)?)', 1))",
        "delimited": r"transform(lines, x -> regexp_extract(lower(x), r'\b((?:error|exception|failed|failure|panic|fatal)\s*[:\-]\s*[^\n]{4,})', 1))",
    },
    {"found": r"filter(transform(joined(typed, delimited), x -> substring(lower(trim(replace_all(x, r'\s+', ' '))), 1, 180)), x -> length(x) >= 8)"},
    {"signatures": "array_join(head(array_sort(array_distinct(found)), 12), '|')"},
]

#: From text: superseded episodes that it names, paths that it mentions, and files it names by a known ending.
MENTIONS = [
    {
        "ids": r"regexp_extract_all(lower(text), r'(?:↺|\bsupersedes\b)[:\s]+(episode-[0-9a-f]{8,64})', 1)",
        "files": r"regexp_extract_all(text, r'([A-Za-z0-9_./-]+[.](?:tsx|ts|jsx|js|mjs|cjs|py|md|json|rs|scss|css|sql|html|sh|toml|yaml|yml|txt))\b', 1)",
        "absolute": r"regexp_extract_all(text, r'(/(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+)', 1)",
    },
    {"superseded": "array_join(first_distinct(ids), ' ')", "mentioned": "array_join(array_sort(array_distinct(files)), ' ')", "named": r"array_join(array_sort(array_distinct(transform(joined(absolute, files), x -> replace_all(x, r'^(/home/[^/]+/[^/]+/|[.]/)', '')))), ' ')"},
]

#: From (haystack, value): whether a literal survives in a text between other signs, itself, its value part, or its plain number.
CONSERVED = [
    {"part": r"trim(regexp_extract(value, r'[=:][ ]?(.+)$', 1))"},
    {"bare": "CASE WHEN part = '' THEN value ELSE part END"},
    {"number": r"CASE WHEN regexp_like(bare, r'^[0-9]{1,15}([.]0+)?$') THEN CAST(CAST(regexp_extract(bare, r'^([0-9]+)', 1) AS BIGINT) AS VARCHAR(40)) ELSE bare END"},
    {"whole": "between_signs(haystack, value)", "as_part": "between_signs(haystack, bare)", "as_number": "between_signs(haystack, number)"},
    {"conserved": "whole OR as_part OR as_number"},
]

#: From (text, value): the identifier before the first clean occurrence of a literal, up to 24 characters.
LABEL = [
    {"plain": r"NOT regexp_like(value, r'[/=:]') AND substring(value, 1, 1) <> '#'"},
    {"before": r"CASE WHEN plain THEN regexp_extract(text, r'^((?:[\s\S]*?[^A-Za-z0-9])?)' || quoted(value) || r'(?:[^A-Za-z0-9]|$)', 1) ELSE '' END"},
    {"word": r"regexp_extract(replace_all(before, r'[\x22\x27\s:=.\-]+$', ''), r'([A-Za-z_][A-Za-z0-9_.\-]{1,40})$', 1)"},
    {"label": r"CASE WHEN regexp_like(word, r'^[0-9a-fA-F]*$') THEN '' ELSE substring(word, 1, 24) END"},
]

#: From text: without recall cards, hints and vaults that were put in.
STRIPS = [
    {"no_vault": r"replace_all(text, r'[ \t]*\n{0,2}\[User Message Vault\]\n(?:[^\n]*\n)*?\[/User Message Vault\](?:\n{1,2}[ \t]*|$)', chr(10) || chr(10))"},
    {"no_cards": r"replace_all(no_vault, r'[ \t]*\n{0,2}\[Recalled from fold —[\s\S]*?\[End fold recall\]\n{0,2}[ \t]*', chr(10) || chr(10))"},
    {"no_hints": r"replace_all(no_cards, r'[ \t]*\n{0,2}\[Fold recall hint —[^\n]*(?:\n{1,3}[ \t]*|$)', chr(10) || chr(10))"},
    {"clean": r"replace_all(replace_all(no_hints, r'^\n+', ''), r'\n+$', '')"},
]

#: From path: without ``.``, ``..`` and empty segments, and whose workspace it is in (two roots, the longer wins).
CANONICAL = [
    {"absolute": "substring(path, 1, 1) = '/'", "segments": "filter(pieces(path, '/'), x -> x <> '' AND x <> '.')"},
    {"walked": "walk_up(segments)"},
    {"normal": "CASE WHEN absolute THEN '/' || replace_all(walked, r'^([.][.]/?)+', '') ELSE walked END"},
    {"workspace": "CASE WHEN regexp_like(normal, r'^/home/u/repo/packages(/|$)') THEN 'packages' WHEN regexp_like(normal, r'^/home/u/repo(/|$)') THEN 'repo' END"},
    {"relative": r"CASE workspace WHEN 'packages' THEN replace_all(normal, r'^/home/u/repo/packages/?', '') WHEN 'repo' THEN replace_all(normal, r'^/home/u/repo/?', '') END"},
]
