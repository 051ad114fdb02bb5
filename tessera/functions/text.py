"""Column builders for text: tokens, estimates, normal forms, identities and rules. All stay in generated code."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import lexicon as L


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def words(text: Column) -> Column:
    """Runs outside white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def bare(text: Column) -> Column:
    """Text without white space at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def token_estimate(text: Column) -> Column:
    """The larger of characters / 4, rounded up, and words * 1.3, cut; 0 for blank text."""
    n = F.greatest(F.ceil(F.char_length(text) / 4).cast("bigint"), (F.size(words(text)) * 1.3).cast("bigint"))
    return F.when(bare(text) == "", F.lit(0).cast("bigint")).otherwise(n)


def context_tokens(text: Column) -> Column:
    """The larger of words and bytes / 4, of the trimmed text."""
    t = bare(text)
    return F.greatest(F.size(words(t)).cast("bigint"), F.floor(F.octet_length(t) / 4).cast("bigint"))


def normal_markdown(text: Column) -> Column:
    """Line feeds only, no blanks at line ends, two line feeds in a row at most, trimmed."""
    t = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    t = F.regexp_replace(t, r"[ \t]+(\n|$)", "$1")
    return bare(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def content_hash(text: Column) -> Column:
    return F.sha2(normal_markdown(text), 256)


def chunk_fingerprint(document: Column, path: Column, level: Column, pages: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("|", document, path, level.cast("string"), F.concat(F.lit("["), F.array_join(pages, " "), F.lit("]")), normal_markdown(text)), 256)


def index_signature(digest: Column, provider: str, model: str, version: str, schema: str) -> Column:
    return F.sha2(F.concat_ws(":", digest, *map(F.lit, (provider, model, version, schema))), 256)


def point_id(document: Column, path: Column, order: Column) -> Column:
    """A UUID of version 5 from the first 16 bytes of a SHA-256."""
    h = F.sha2(F.concat_ws(":", document, path, order.cast("string")), 256)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


#: Lower-case Latin letters with marks and the letters that they stand on, by canonical decomposition.
_BASES = {c: d[0] for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if c == c.lower() and (d := unicodedata.normalize("NFD", c)) != c and "a" <= d[0] <= "z"}
ACCENTED, PLAIN = "".join(_BASES), "".join(_BASES.values())


def slug(text: Column) -> Column:
    """Letters without marks, digits, and hyphens for all else; `section` where nothing is left."""
    letters = F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), r"\p{Mn}", "")
    s = F.regexp_replace(letters, "[^a-z0-9]+", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    return F.when(s == "", F.lit("section")).otherwise(s)


def concept_slug(text: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(bare(text)), F.lit(" "), F.lit("-")), "[^a-z0-9-]", "")


def normal_heading(text: Column) -> Column:
    s = F.lower(F.regexp_replace(text, "[’`]", "'"))
    s = F.replace(F.regexp_replace(s, r"[^\p{L}\p{N} ']", " "), F.lit("'"), F.lit(""))
    return bare(F.regexp_replace(s, r"\s+", " "))


def language(text: Column) -> Column:
    """`tr` where two markers or more occur, else `en`."""
    low = F.lower(text)
    n = reduce(lambda a, m: a + low.contains(m).cast("int"), L.TURKISH_MARKERS, F.lit(0))
    return F.when(n >= 2, F.lit("tr")).otherwise(F.lit("en"))


def paragraph_category(text: Column) -> Column:
    low = F.lower(text)
    starts = lambda *xs: reduce(lambda a, x: a | low.startswith(x), xs, F.lit(False))
    return (
        F.when(starts("note:", "warning:", "caution:", "important:"), "warning")
        .when(low.contains("is defined as") | low.contains("refers to") | starts("definition:"), "definition")
        .when(starts("for example:", "e.g.,", "example:"), "example")
        .when(starts("see ", "refer to "), "reference")
        .otherwise("narrative")
    )


def is_list_item(line: Column) -> Column:
    numbered = line.rlike("^[0-9]") & (F.length(line) > 2) & F.instr(line, ". ").between(2, 5)
    return line.startswith("- ") | line.startswith("* ") | line.startswith("+ ") | numbered


def first_sentence(text: Column) -> Column:
    """The first piece before a full stop and blank that has anything in it, with a full stop."""
    parts = F.filter(F.transform(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), r"\. "), bare), lambda s: s != "")
    s = F.get(parts, 0)
    return F.when(s.endswith("."), s).otherwise(F.concat(s, F.lit(".")))


def keyword_tokens(text: Column) -> Column:
    """Lower-case runs of letters, numbers and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def question_tokens(text: Column, stopwords=L.QUESTION_STOPWORDS) -> Column:
    parts = F.transform(words(F.replace(F.lower(text), F.lit("'"), F.lit(""))), lambda w: F.regexp_replace(w, r"""^[?,.'"!():;-]+|[?,.'"!():;-]+$""", ""))
    return F.filter(parts, lambda w: (F.length(w) > 1) & ~w.isin(*stopwords))


def intent(query: Column) -> Column:
    q = bare(query)
    low = F.lower(q)
    return (
        F.when(low.startswith("who") | low.contains("author") | q.rlike(L.ENTITY_QUESTION), "entity_lookup")
        .when(low.startswith("how"), "procedural_lookup")
        .otherwise("concept_lookup")
    )


def comparison(query: Column) -> Column:
    """The two sides of a comparison question, or null."""
    q = bare(query)
    cases = []
    for pattern in L.COMPARISONS:
        left, right = (bare(F.regexp_extract(q, pattern, k)) for k in (1, 2))
        cases.append(F.when((left != "") & (right != "") & (F.lower(left) != F.lower(right)), F.array(left, right)))
    return F.coalesce(*cases)
