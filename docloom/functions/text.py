"""Column builders for text: words, tags, sections, identifiers, snippets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SearchConfig

#: Section markers, matched without regard to case; white space and colons after one belong to it.
MARKERS = {
    "fabula": ("Фабула дела", "Обстоятельства дела"),
    "lower_courts": ("Постановления судов", "Судебные акты", "Позиция нижестоящих судов?", "Постановления нижестоящих судов?"),
    "vs_position": ("Позиция Верховного [Сс]уда", "Позиция ВС", "Верховный [Сс]уд указал[аои]?", "СК[ГЭ]С указал[аои]?", "Выводы Верховного [Сс]уда"),
}

#: Case number forms, in order: pattern and canonical form.
CASE_IDS = (
    (r"\b(\d{2,3})[\s-]?[Ээ][Сс][\s-]?(\d{1,2})[\s-]?(\d{2,6})", "$1-ЭС$2-$3"),
    (r"\bА\s*(\d{1,3})[\s-](\d{1,7})\s*/\s*(\d{4})", "А$1-$2/$3"),
    (r"\b(\d{1,3})[\s-]?КГ[\s-]?(\d{1,2})[\s-]?(\d{1,6})", "$1-КГ$2-$3"),
)

_SPACE = r"(?U)^\s+|\s+$"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at the ends, Unicode blanks included."""
    return F.regexp_replace(c, _SPACE, "")


def tokens(text: Column, config: SearchConfig = SearchConfig(), lemma: Column | None = None) -> Column:
    """Lower-cased words without short ones and stop words; ``lemma``: a map of word to lemma."""
    stop = config.stop_words  # a list of literals becomes one hash lookup a word
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(config.token), F.lit(0))
    kept = F.filter(words, lambda w: (F.length(w) >= config.min_token) & ~w.isin(*stop))
    if lemma is None:
        return kept
    return F.filter(F.transform(kept, lambda w: F.coalesce(F.try_element_at(lemma, w), w)), lambda w: ~w.isin(*stop))


def word_counts(words: Column) -> Column:
    """Array of (term, tf): the distinct words in order, by the runs of the sorted ones."""

    def runs(s: Column) -> Column:
        at = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        return let(at, lambda a: F.transform(a, lambda p, j: F.struct(F.get(s, p).alias("term"), (F.coalesce(F.get(a, j + 1), F.size(s)) - p).alias("tf"))))

    return let(F.sort_array(words), runs)


def norm_tag(tag: Column) -> Column:
    return F.regexp_replace(F.lower(tag), r"(?U)[\s_-]+", "")


def sections(text: Column) -> Column:
    """Struct of fabula, lower_courts, vs_position, residual. Every marker becomes a sign of its section, the text is
    split before the signs, and chunks of one section are joined by line feeds."""
    signs = {"fabula": "\u0011", "lower_courts": "\u0012", "vs_position": "\u0013"}
    marked = text
    every = [(s, m) for s, ms in MARKERS.items() for m in ms]
    for s, m in sorted(every, key=lambda x: -len(x[1])):
        marked = F.regexp_replace(marked, rf"(?iuU){m}[:\s]*", "\u0001" + signs[s])
    chunks = F.split(marked, "\u0001")

    def of(sign: str) -> Column:
        own = F.transform(F.filter(F.slice(chunks, 2, F.greatest(F.size(chunks) - 1, F.lit(0))), lambda c: c.startswith(sign)), lambda c: strip(F.substring(c, 2, 1 << 30)))
        return F.aggregate(own, F.lit(""), lambda a, x: F.when(a == "", x).otherwise(F.concat(a, F.lit("\n"), x)))

    residual = F.when(F.size(chunks) == 1, text).otherwise(strip(F.element_at(chunks, 1)))
    return F.struct(*[of(signs[s]).alias(s) for s in signs], residual.alias("residual"))


def case_ids(*texts: Column) -> Column:
    """Canonical case numbers in order of pattern within each text, first occurrences only."""
    found = []
    for t in texts:
        clean = F.regexp_replace(F.coalesce(t, F.lit("")), r"(?U)\s+", " ")
        for pattern, form in CASE_IDS:
            hits = F.regexp_extract_all(clean, F.lit("(?U)" + pattern), F.lit(0))
            found.append(_canonical(hits, pattern, form))
    return F.array_distinct(F.concat(*found))


def _canonical(hits: Column, pattern: str, form: str) -> Column:
    return F.transform(hits, lambda h: F.regexp_replace(h, "(?U)" + pattern, form))


def primary_id(ids: Column) -> Column:
    return F.coalesce(F.get(ids, F.lit(0)), F.lit(""))


def snippet(vs: Column, residual: Column, title: Column, n: int = 250) -> Column:
    """First of the three that is not empty, on one line, cut after its last full stop in the second half of the
    first n characters, else at n with an ellipsis."""
    some = lambda c: F.when(F.length(c) > 0, c)
    body = F.regexp_replace(strip(F.coalesce(some(vs), some(residual), some(title), F.lit(""))), "\n", " ")
    head = F.substring(body, 1, n)
    back = F.locate(".", F.reverse(head))
    dot = F.when(back > 0, n - back).otherwise(F.lit(-1))
    return F.when(F.length(body) <= n, body).when(dot > n // 2, F.substring(body, F.lit(1), dot + 1)).otherwise(F.concat(head, F.lit("...")))


def embedding_text(title: Column, vs: Column, fabula: Column, residual: Column, text: Column) -> Column:
    some = lambda c: F.when(F.length(c) > 0, c)
    body = F.when((F.length(vs) == 0) & (F.length(fabula) == 0), F.substring(F.coalesce(some(residual), text), 1, 8000))
    return F.concat_ws("\n", some(title), F.when(F.length(vs) > 0, F.concat(F.lit("Позиция ВС: "), vs)), F.when(F.length(fabula) > 0, F.concat(F.lit("Фабула: "), fabula)), some(body))


def query_key(query: Column) -> Column:
    return F.sha2(F.regexp_replace(strip(F.lower(query)), r"(?U)\s+", " "), 256)


def split_csv(value: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), "[;,]"), strip), lambda x: x != "")


def clean_hashtags(items: Column) -> Column:
    return F.filter(F.transform(items, lambda t: strip(F.regexp_replace(t, "^#+", ""))), lambda t: t != "")


def channel(source: Column) -> Column:
    name = F.regexp_extract(source, "(?U)канал\\s+«([^»]+)»", 1)
    return F.when(name != "", strip(name)).otherwise(strip(source))


def collapse_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def digit_runs(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit(r"\d+"), F.lit(0))
