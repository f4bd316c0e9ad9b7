"""Text matching and shaping as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.binding import let


def blank(value: Column) -> Column:
    return value.isNull() | (F.trim(value) == "")


def nonblank(value: Column) -> Column:
    return F.when(~blank(value), value)


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(text: Column, terms) -> Column:
    """Substring test against a short fixed list; stays inside codegen."""
    return any_of([F.contains(text, F.lit(t)) for t in terms])


def joined_lower(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))


def match_categories(text: Column, table: dict) -> Column:
    """Names of the categories with at least one term inside the text."""
    return F.array_compact(
        F.array(*[F.when(contains_any(text, terms), F.lit(name)) for name, terms in table.items()])
    )


def quote_regex(term: str) -> str:
    return "".join("\\" + c if c in r".^$*+?{}[]\|()-" else c for c in term)


def has_term(text: Column, terms) -> Column:
    """Latin terms need a non-alphanumeric neighbour on both sides; other scripts
    match anywhere."""
    latin = [t for t in terms if any("a" <= c <= "z" for c in t)]
    other = [t for t in terms if t not in latin]
    tests = []
    if latin:
        body = "|".join(quote_regex(t) for t in latin)
        tests.append(text.rlike(f"(?<![a-z0-9])(?:{body})(?![a-z0-9])"))
    if other:
        tests.append(contains_any(text, other))
    return any_of(tests)


def tokens(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)))


def significant_terms(text: Column, stop_words=()) -> Column:
    found = tokens(text, r"[a-z0-9]{3,}")
    if stop_words:
        found = F.array_except(found, F.array(*[F.lit(w) for w in stop_words]))
    return found


def title_keywords(text: Column) -> Column:
    return tokens(text, r"[a-z][a-z0-9\-]{2,}")


def squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def short_text(text: Column, limit: int = 160) -> Column:
    flat = squash(text)
    return F.when(flat == "", F.lit(None)).otherwise(
        F.when(F.length(flat) <= limit, flat).otherwise(
            F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))
        )
    )


def codes(*pairs) -> Column:
    """Ordered list of the codes whose condition holds."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond in pairs]))


def map_lookup(key: Column, mapping: dict) -> Column:
    out = None
    for source, target in mapping.items():
        hit = key == source
        out = F.when(hit, F.lit(target)) if out is None else out.when(hit, F.lit(target))
    return out


def token_similarity(left: Column, right: Column) -> Column:
    """Jaccard of lower-cased tokens in percent; 0 when either side is empty."""
    pattern = r"[a-z0-9][a-z0-9\-]+"
    a, b = tokens(F.coalesce(left, F.lit("")), pattern), tokens(F.coalesce(right, F.lit("")), pattern)
    shared, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    pct = F.bround(F.try_divide(shared, union) * 100, 0)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(pct.cast("int"))


def unique_ignoring_case(values: Column) -> Column:
    """First spelling of every value, in order. Bind ``values`` when it is costly."""
    return let(
        F.transform(values, F.lower),
        lambda folded: F.filter(values, lambda v, i: F.array_position(folded, F.lower(v)) == i + 1),
    )


# --- titles, brands, scripts, replies -----------------------------------------------

_TITLE_CUT = r"\s[\-–—|｜:：]\s|[:：|｜–—]"


def short_title(title: Column) -> Column:
    """Title up to its first separator, without bracketed parts."""
    head = F.get(F.split(F.coalesce(title, F.lit("")), _TITLE_CUT, 2), 0)
    bare = F.regexp_replace(head, r"[\(（\[【].*?[\)）\]】]", "")
    return F.trim(squash(bare), F.lit(" -–—|｜:："))


def brand_phrases(text: Column, stop_words, limit: int | None = None) -> Column:
    """Title-case phrases, at most the first ``limit``; a single common word is no brand."""
    pattern = r"\b([A-Z][A-Za-z0-9&']+(?:\s[A-Z][A-Za-z0-9&']+){0,2})\b"
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1)), squash)
    kept = F.filter(
        found,
        lambda w: (F.length(w) >= 3) & (F.contains(w, F.lit(" ")) | ~F.lower(w).isin(*stop_words)),
    )
    phrases = let(kept, unique_ignoring_case)
    return phrases if limit is None else F.slice(phrases, 1, limit)


def name_script(name: Column) -> Column:
    """latin when 60 % of the letters are Latin, non_latin, or no_maker_name."""
    letters = F.length(F.regexp_replace(name, r"[^\p{L}]", ""))
    latin = F.length(F.regexp_replace(name, r"[^\p{IsLatin}]", ""))
    return (
        F.when(F.coalesce(letters, F.lit(0)) == 0, "no_maker_name")
        .when(latin / letters >= 0.6, "latin")
        .otherwise("non_latin")
    )


_PUNCTUATION = ("“”„‟″‘’‚‛–—−  　", "\"\"\"\"\"''''---  ")


def plain_punctuation(text: Column) -> Column:
    """Smart quotes, dashes and odd spaces to ASCII, blanks collapsed; NFKC comes first."""
    flat = F.replace(F.translate(text, *_PUNCTUATION), F.lit("…"), F.lit("..."))
    return squash(flat)


def reply_labels(text: Column, intents, positive, negative) -> dict[str, Column]:
    low = F.lower(F.coalesce(text, F.lit("")))
    intent = None
    for name, words in intents:
        hit = contains_any(low, words)
        intent = F.when(hit, F.lit(name)) if intent is None else intent.when(hit, F.lit(name))
    intent = intent.otherwise("unclear")
    hits = lambda words: sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))
    n_neg, n_pos = hits(negative), hits(positive)
    sentiment = F.when(n_neg > n_pos, "negative").when(n_pos > 0, "positive").otherwise("neutral")
    return {
        "intent": intent,
        "sentiment": sentiment,
        "language": F.when(text.rlike(r"[぀-ヿ一-鿿]"), "ja").otherwise("en"),
        "confidence": F.when(intent == "unclear", "low").when(sentiment == "neutral", "medium").otherwise("high"),
    }


def trim_at_word(text: Column, limit: int) -> Column:
    """Cut at the last blank past 60 % of the limit, with an ellipsis."""
    cut = F.substring(text, 1, limit)
    blank_at = F.length(F.regexp_extract(cut, r"(?s)^(.*) ", 1))
    body = F.when(F.contains(cut, F.lit(" ")) & (blank_at > limit * 0.6), F.substring(cut, 1, blank_at)).otherwise(cut)
    clean = F.regexp_replace(body, r"[ .,、。\n]+$", "")
    return F.when(F.length(text) > limit, F.concat(clean, F.lit("…"))).otherwise(text)


_DROPPED = ("script", "style", "noscript", "template", "picture", "figure", "svg", "video", "iframe")
_BLOCKS = (
    "p", "div", "br", "li", "ul", "ol", "tr", "table", "section", "article", "header", "footer", "h1",
    "h2", "h3", "h4", "h5", "h6", "blockquote", "pre",
)


def strip_markup(html: Column) -> Column:
    """Page text with entities still encoded: media and scripts dropped with their
    content, block tags turned into line breaks."""
    text = html
    for tag in _DROPPED:
        text = F.regexp_replace(text, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    text = F.regexp_replace(text, r"(?is)<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?i)</?(?:" + "|".join(_BLOCKS) + r")\b[^>]*>", "\n")
    return F.regexp_replace(text, r"<[^>]+>", "")


def tidy_lines(text: Column) -> Column:
    """Blanks collapsed per line, empty lines dropped."""
    one = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t ​]+", " ")
    lines = F.filter(F.transform(F.split(one, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    return F.nullif(F.array_join(lines, "\n"), F.lit(""))


def html_to_text(html: Column, max_len: int | None = None) -> Column:
    from leadloom.functions.pandas_udfs import unescape_entities

    text = tidy_lines(unescape_entities(strip_markup(html)))
    return text if max_len is None else trim_at_word(text, max_len)
