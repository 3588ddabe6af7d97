"""Scalar text functions as column expressions, each with the SQL text that says the same.

Lengths are in code points. Tokens are lower-case runs over letters a to z, digits and ``_ . / -``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes stripped by the stemmer, tried in this order.
SUFFIXES = (
    "ization", "ational", "fulness", "ousness", "iveness",
    "ation", "ition", "ement", "ously", "izing", "ising",
    "ities", "iness", "ality",
    "tion", "sion", "ions", "ized", "izer", "izes", "ings", "iest", "edly",
    "ing", "ies", "ied", "ier", "ers", "est", "ity", "ize",
    "ed", "er", "es", "ly",
    "s",
)
MIN_STEM = 4

# English function words that carry no topic.
STOPWORDS = (
    "the of a an and or to is are was were be been being am in on at by for with as it its "
    "this that these those i you we they he she him her them us our your their my me if so but "
    "not no yes do does did done have has had having will would can could should shall may might must "
    "then than too very just up out off over under again here there what which who whom how why when "
    "where all any some such more most one two from into about also only own same each both few now "
    "against between among through throughout during before after above below within without because while until "
    "unless whether though although however therefore otherwise instead upon toward towards per via still yet ever "
    "never always often once whose whoever whatever whenever wherever whichever every either neither nor because "
    "isn arent aren doesn didn don wasn weren hasn hadn haven wouldn couldn shouldn mustn needn won "
    "wont cant dont didnt doesnt isnt wasnt"
).split()

# Reserved words of programming languages.
CODE_WORDS = (
    "import export default require module const let var function return async await yield class interface type "
    "enum namespace extends implements public private protected static readonly abstract override declare void null "
    "undefined true false new delete typeof instanceof keyof this super throw try catch finally switch case break "
    "continue else for while const let string number boolean object symbol bigint unknown never any infer "
    "satisfies as from with def elif lambda pass raise except fn impl pub struct trait mut use self"
).split()

# Glyph that opens a message, its register, and whether that register is durable, final and how far trusted.
REGISTERS = (
    ("🔍", "in_progress", "transient", False, False),
    ("▶", "executing", "transient", False, False),
    ("🏁", "verdict", "durable", True, True),
    ("⚠", "hazard", "durable", True, True),
    ("❓", "blocked", "blocked", False, True),
)

_W = "[A-Za-z0-9_]"
# Shapes of literals worth carrying word for word, in order of priority.
LITERALS = (
    ("uuid", r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    ("hex", r"[0-9a-fA-F]{12,64}"),
    ("iso_time", r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,9})?(?:Z|[+-][0-9]{2}:[0-9]{2})"),
)
KEY_VALUE = r"[A-Za-z_][A-Za-z0-9_.-]{0,40}[=:][ ]?[A-Za-z0-9_./:@-]{4,80}"
ISSUE = r"(?:^|\s)(#[0-9]{2,8})(?:$|[^A-Za-z0-9_])"


def tokens(text: Column) -> Column:
    """Tokens of 2 to 79 characters in their order."""
    clean = F.regexp_replace(F.lower(text), r"[^a-z0-9_./\-\s]", " ")
    return F.filter(F.split(clean, r"\s+"), lambda t: F.length(t).between(2, 79))


TOKENS_SQL = r"list_filter(string_split_regex(regexp_replace(lower({0}), '[^a-z0-9_./\-\s]', ' ', 'g'), '\s+'), lambda t: len(t) BETWEEN 2 AND 79)"


def _stemmed(suffix: str) -> str:
    """What replaces a suffix."""
    return {"ies": "y", "ied": "y", "es": "e"}.get(suffix, "")


def stem(token: Column) -> Column:
    """The token without its first matching suffix, if four characters remain; a final ``ss`` stays."""
    out = F.when(F.length(token) <= MIN_STEM, token)
    for suffix in SUFFIXES:
        fits = (F.length(token) - len(suffix) >= MIN_STEM) & token.endswith(suffix)
        cut = F.concat(F.substring(token, F.lit(1), F.length(token) - len(suffix)), F.lit(_stemmed(suffix)))
        out = out.when(fits, F.when(token.endswith("ss"), token).otherwise(cut) if suffix == "s" else cut)
    return out.otherwise(token)


def stem_sql(token: str) -> str:
    cases = [f"WHEN len({token}) <= {MIN_STEM} THEN {token}"]
    for suffix in SUFFIXES:
        cut = f"left({token}, len({token}) - {len(suffix)}) || '{_stemmed(suffix)}'"
        if suffix == "s":
            cut = f"CASE WHEN {token} LIKE '%ss' THEN {token} ELSE {cut} END"
        cases.append(f"WHEN len({token}) - {len(suffix)} >= {MIN_STEM} AND {token} LIKE '%{suffix}' THEN {cut}")
    return "CASE " + " ".join(cases) + f" ELSE {token} END"


def distinctive_terms(text: Column, shortest: int = 3) -> Column:
    """Stems of the tokens that are neither function nor reserved words, once each in their order."""
    dull = list(dict.fromkeys([*STOPWORDS, *CODE_WORDS]))
    kept = F.filter(tokens(text), lambda t: (F.length(t) >= shortest) & ~t.isin(dull))
    return F.array_distinct(F.transform(kept, stem))


def terms_sql(text: str, shortest: int = 3) -> str:
    """A list of distinct stems, in no order."""
    dull = ", ".join(f"'{w}'" for w in dict.fromkeys([*STOPWORDS, *CODE_WORDS]))
    kept = f"list_filter({TOKENS_SQL.format(text)}, lambda t: len(t) >= {shortest} AND t NOT IN ({dull}))"
    return f"list_distinct(list_transform({kept}, lambda t: {stem_sql('t')}))"


def whole(pattern: str) -> str:
    """A Java pattern that matches only where no word character touches."""
    return f"(?<!{_W}){pattern}(?!{_W})"


def literals(text: Column, cap: int = 40) -> Column:
    """Distinct literals by priority of shape, then place; at most ``cap``."""
    found = [F.regexp_extract_all(text, F.lit(whole(p)), F.lit(0)) for _, p in LITERALS]
    return F.slice(F.array_distinct(F.concat(*found)), 1, cap)


def register(text: Column, field: int = 1) -> Column:
    """Register (1), trust (2), durable (3) or final (4) of the glyph that opens the text; null without one."""
    return reduce(lambda out, r: out.when(text.startswith(r[0]), F.lit(r[field])), REGISTERS[1:], F.when(text.startswith(REGISTERS[0][0]), F.lit(REGISTERS[0][field])))


def register_sql(text: str, field: int = 1) -> str:
    value = lambda r: f"'{r[field]}'" if isinstance(r[field], str) else str(r[field]).lower()
    return "CASE " + " ".join(f"WHEN starts_with({text}, '{r[0]}') THEN {value(r)}" for r in REGISTERS) + " END"


def project_path(path: Column) -> Column:
    """The path without a leading home and project folder."""
    return F.regexp_replace(path, "^/home/[^/]+/[^/]+/", "")


def clipped(text: Column, most: int) -> Column:
    """The text, or its first 70 % and last 30 % of ``most`` characters around a note of what is left out."""
    head, tail = most * 7 // 10, most - most * 7 // 10
    note = F.concat(F.lit("\n[... "), (F.length(text) - most).cast("string"), F.lit(" characters omitted ...]\n"))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(head)), note, F.right(text, F.lit(tail))))


def clipped_sql(text: str, most: int) -> str:
    head, tail = most * 7 // 10, most - most * 7 // 10
    return f"CASE WHEN len({text}) <= {most} THEN {text} ELSE left({text}, {head}) || chr(10) || '[... ' || (len({text}) - {most})::VARCHAR || ' characters omitted ...]' || chr(10) || right({text}, {tail}) END"


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the UTF-16 units of a text, as a number."""
    units = F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(.{4})"), F.lit(1)), lambda u: F.conv(u, 16, 10).cast("long"))
    return F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, u: ((h.bitwiseXOR(u)) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF)))


#: The same for DuckDB: a code point beyond the basic plane is two units.
FNV_SQL = (
    "list_reduce(flatten(list_transform(list_filter(string_split({0}, ''), lambda c: c <> ''), lambda c: CASE WHEN unicode(c) > 65535 THEN [55296 + ((unicode(c) - 65536) >> 10), 56320 + ((unicode(c) - 65536) & 1023)] "
    "ELSE [unicode(c)] END)), lambda h, c: (xor(h, c::BIGINT) * 16777619) & 4294967295, 2166136261::BIGINT)"
)


def clock(ts: Column) -> Column:
    """A time of day as [h:mm AM]."""
    return F.concat(F.lit("["), F.date_format(ts, "h:mm a"), F.lit("]"))
