"""Text functions as Column expressions: cleaning, tokens, sentences."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Java's regular expressions see only ASCII unless told: (?U) for classes such as \\s, (?iu) for case.
UNICODE, ANY_CASE = "(?U)", "(?iuU)"

# Cleaning rules by name, each with the patterns whose matches become a space.
CLEAN_RULES: dict[str, tuple[str, ...]] = {
    "media_placeholder": ("존재하지 않는 이미지입니다", "존재하지 않는 스티커입니다", "Previous imageNext image"),
    "html_artifact": (r"<br\s*/?>", "&nbsp;"),
    "url_cleanup": (r"https?://\S+", r"www\.\S+"),
    "zero_width_cleanup": (r"[\u200b-\u200d\ufeff]",),
}
# Phrases that are taken out of texts wherever they stand.
KNOWN_PHRASES = ("존재하지 않는 이미지입니다", "존재하지 않는 스티커입니다", "Previous imageNext image")
# Noise inside sentences.
NOISE = (
    r"존재하지 않는 이미지입니다\.?",
    r"존재하지 않는 스티커입니다\.?",
    r"네트워크 오류가 발생했습니다\.?",
    r"50m NAVER Corp\.[^.!?]{0,300}",
    r"\d+(?:km|m)\s*NAVER Corp\.[^.!?]{0,300}",
    r"NAVER Corp\.[^.!?]{0,300}",
    r"재생\d+:\d{2}",
)
# Signs of advertising and placeholders.
GARBAGE: dict[str, tuple[str, ...]] = {
    "ad_marker": (r"#?\s*광고", r"#?\s*협찬", "체험단", "원고료", r"유료\s*광고", r"소정의\s*수수료", r"쿠팡\s*파트너스", r"파트너스\s*활동", "sponsored", "advertisement"),
    "promotion_link": (r"프로필\s*링크", r"링크\s*클릭", r"구매\s*링크", r"자세한\s*내용은\s*링크", r"문의는?\s*dm", r"상담은?\s*dm"),
    "platform_placeholder": KNOWN_PHRASES,
}
# Words of no use as tokens, particles that end Korean nouns, and the token pattern.
STOPWORDS = (
    "the",
    "and",
    "for",
    "with",
    "this",
    "that",
    "from",
    "have",
    "were",
    "will",
    "about",
    "error",
    "issue",
    "please",
    "there",
    "있습니다",
    "합니다",
    "계속",
    "문의",
    "내용",
    "확인",
    "처리",
    "대한",
    "관련",
)
PARTICLES = ("이", "가", "은", "는", "을", "를", "와", "과", "도", "에")
TOKEN = "[0-9A-Za-z가-힣]{2,}"


#: The characters of (?U)\\s.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Without white space (of any script) at both ends. Only the ends are looked at."""
    return F.btrim(c, F.lit(WHITE))


def _any_case(pattern: str) -> str:
    """The pattern with flags for any case, which search far slower, only where it has letters with cases."""
    bare = re.sub(r"\\u[0-9a-f]{4}", "", pattern)
    return (ANY_CASE if bare.lower() != bare.upper() else UNICODE) + pattern


def clean_rules(c: Column, rules: Sequence[str] = tuple(CLEAN_RULES), more: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Each match of the named rules' patterns becomes a space, in any case. `more` adds or replaces rules."""
    known = {**CLEAN_RULES, **(more or {})}
    for name in rules:
        for pattern in known[name]:
            c = F.regexp_replace(c, _any_case(pattern), " ")
    return c


def scrub_noise(c: Column, patterns: Sequence[str] = NOISE) -> Column:
    for pattern in patterns:
        c = F.regexp_replace(c, UNICODE + pattern, " ")
    return c


def noise_hits(c: Column, patterns: Sequence[str] = NOISE) -> Column:
    """How many matches scrub_noise would replace, each pattern after those before it."""
    total = F.lit(0)
    for pattern in patterns:
        total = total + F.size(F.regexp_extract_all(c, F.lit(UNICODE + pattern), F.lit(0)))
        c = F.regexp_replace(c, UNICODE + pattern, " ")
    return total


def strip_phrases(c: Column, phrases: Sequence[str] = KNOWN_PHRASES) -> Column:
    return F.regexp_replace(c, "|".join(rf"\Q{p}\E" for p in phrases), " ") if phrases else c


def normalise_space(c: Column) -> Column:
    """Line ends to newlines, other runs of white space to a space, none around newlines, newline runs to one, none at the ends."""
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(c, UNICODE + r"[^\S\n]+", " ")
    c = F.regexp_replace(c, " ?\n ?", "\n")
    return strip(F.regexp_replace(c, "\n+", "\n"))


def normalise_marks(c: Column) -> Column:
    """Runs of ! ? . become a full stop; runs of three or more of _ - = / a space."""
    return F.regexp_replace(F.regexp_replace(c, "[!?.]{2,}", "."), r"[_\-=/]{3,}", " ")


def join_text(columns: Sequence[Column], joiner: str = "\n\n") -> Column:
    """The columns that aren't blank, trimmed, with the joiner between them."""
    parts = [F.when(strip(c) != "", strip(c)) for c in columns]
    return strip(F.concat_ws(joiner, *parts))


def cut_particle(token: Column) -> Column:
    """A token of three letters or more without a Korean particle at its end."""
    ends = (F.length(token) >= 3) & F.substring(token, -1, 1).isin(*PARTICLES)
    return F.when(ends, F.left(token, F.length(token) - 1)).otherwise(token)


def tokens(c: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Array of tokens in order: lower case, particles cut, without stopwords."""
    found = F.transform(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0)), cut_particle)
    return F.filter(found, lambda t: ~t.isin(*stopwords)) if stopwords else found


def keywords(c: Column, *, least: int = 2, stopwords: Sequence[str] = (), block: Sequence[str] = (), synonyms: Mapping[str, str] | None = None) -> Column:
    """Array of distinct keywords in order: tokens of enough letters that are no number, stopword or blocked word; synonyms last."""
    unwanted = [*stopwords, *block]
    good = F.filter(tokens(c), lambda t: (F.length(t) >= least) & ~t.rlike("^[0-9]+$") & (~t.isin(*unwanted) if unwanted else F.lit(True)))
    return F.array_distinct(F.transform(good, lambda t: replace_words(t, synonyms or {})))


def replace_words(c: Column, synonyms: Mapping[str, str]) -> Column:
    targets: dict[str, list[str]] = {}
    for source, target in synonyms.items():
        if source != target:
            targets.setdefault(target, []).append(source)
    out = None
    for target, sources in targets.items():
        out = F.when(c.isin(*sources), target) if out is None else out.when(c.isin(*sources), target)
    return c if out is None else out.otherwise(c)


#: What parts sentences: white space behind . ! ? (also full-width), and newlines.
BREAK = r"(?<=[.!?。！？])\s+|\n+"
LETTER = "[0-9A-Za-z가-힣]"


def sentences(c: Column) -> Column:
    """Array of sentences: parted behind . ! ? (also full-width) and white space, and at newlines; those without a letter or digit go."""
    parts = F.split(c, UNICODE + BREAK)
    return F.filter(F.transform(parts, strip), lambda s: s.rlike(LETTER))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def totals_before(numbers: Column, block: int = 256) -> Column:
    """Array of the sums of all numbers before each number, and of all of them at the end.

    Sums of blocks come first, so n numbers cost about n * block / 2 additions, not n * n / 2.
    """
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda t, x: t + x)
    places = lambda n: F.sequence(F.lit(0), n)

    def sums(xs: Column) -> Column:
        blocks = F.transform(places(F.floor(F.size(xs) / block).cast("int")), lambda b: total(F.slice(xs, b * block + 1, block)))
        return let(blocks, lambda bs: let(F.transform(places(F.size(bs) - 1), lambda b: total(F.slice(bs, F.lit(1), b))), lambda starts: at_each(xs, starts)))

    def at_each(xs: Column, starts: Column) -> Column:
        return F.transform(places(F.size(xs)), lambda i: F.get(starts, F.floor(i / block).cast("int")) + total(F.slice(xs, (F.floor(i / block) * block + 1).cast("int"), (i % block).cast("int"))))

    return let(numbers, sums)


def sentence_spans(c: Column) -> Column:
    """Array of struct sentence, start, end (code points in the text; end exclusive) of the sentences of a text.

    The text is cut into pieces that each hold a sentence and the white space that ends it, so that places are sums of lengths: the
    cost grows with the text, not with its square.
    """
    pieces = F.regexp_extract_all(c, F.lit(rf"{UNICODE}(?s).+?(?:{BREAK}|\z)"), F.lit(0))

    def spans(ps: Column) -> Column:
        return let(totals_before(F.transform(ps, lambda p: F.length(p))), lambda starts: F.transform(ps, lambda p, i: span(p, F.get(starts, i))))

    def span(piece: Column, at: Column) -> Column:
        start = at + F.length(piece) - F.length(F.regexp_replace(piece, UNICODE + r"^\s+", ""))
        return F.struct(strip(piece).alias("sentence"), start.alias("start"), (start + F.length(strip(piece))).alias("end"))

    return F.filter(let(pieces, spans), lambda s: s["sentence"].rlike(LETTER))


def sentence_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each sentence: id, sentence_index, sentence, start and end (see sentence_spans)."""
    return df.select(id_col, F.posexplode(sentence_spans(F.col(text_col))).alias("sentence_index", "_s")).select(id_col, "sentence_index", "_s.sentence", "_s.start", "_s.end")


def truncate(c: Column, most: int) -> Column:
    """struct text, original_chars, kept_chars, truncated."""
    return F.struct(F.left(c, F.lit(most)).alias("text"), F.length(c).alias("original_chars"), F.least(F.length(c), F.lit(most)).alias("kept_chars"), (F.length(c) > most).alias("truncated"))


def garbage_flags(c: Column, rules: Sequence[str] = (*GARBAGE, "empty_or_noise")) -> Column:
    """Array of those of the named garbage rules that a text meets, in their fixed order; empty_or_noise if no letter or digit is left."""
    flags = [F.when(c.rlike(ANY_CASE + "|".join(f"(?:{p})" for p in patterns)), F.lit(name)) for name, patterns in GARBAGE.items() if name in rules]
    if "empty_or_noise" in rules:
        flags.append(F.when(~F.coalesce(c, F.lit("")).rlike("[0-9A-Za-z가-힣]"), F.lit("empty_or_noise")))
    return F.filter(F.array(*flags), lambda f: f.isNotNull())


def subject_terms(c: Column) -> Column:
    """Array of distinct lower-case terms of two letters or more, parted by white space and the usual separators."""
    parts = F.split(F.lower(c), UNICODE + r"[&/,·・|+()\[\]\-_~\s]+")
    return F.array_distinct(F.filter(parts, lambda t: F.length(t) >= 2))


def parity(c: Column) -> Column:
    """0 or 1 by the md5 of a key: which of two candidates goes first."""
    return F.conv(F.substring(F.md5(c), 32, 1), 16, 10).cast("int") % 2


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)
