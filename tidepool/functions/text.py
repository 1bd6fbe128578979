"""Text functions as column expressions; exact Unicode normalisation is the one Python UDF."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Stopwords dropped by ``tokens``.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "has", "have", "he", "her", "his", "i", "if", "in", "is", "it", "its", "me", "my", "not", "of", "on", "or", "our", "so", "than", "that", "the", "their", "them", "there", "these", "they", "this", "to", "up", "was", "we", "were", "what", "when", "which", "who", "will", "with", "you", "your", "just", "im", "dont", "u", "ur")
# Phrases that promote.
SHILL = ("to the moon", "next 100x", "lfg", "wagmi", "early gem", "dont miss", "don't miss", "aped in", "sending it", "bullish af", "this is the one", "10000x", "buy now", "last chance", "dev based", "based dev", "lock in", "cook", "chart looking", "gem found")
# Phrases that show a position.
CONVICTION = ("i bought", "i sold", "my entry", "took profit", "still holding", "added more", "cut my", "down bad", "up ", "average")
# What a skeleton puts in place of kinds of tokens, in this order.
KINDS = ((r"https?://\S+|www\.\S+", "url"), (r"[@＠][A-Za-z0-9_]{1,30}", "at"), (r"\$[A-Za-z][A-Za-z0-9]{0,14}\b", "tick"), (r"[#＃]\w{1,60}", "tag"), (r"\d[\d,._]*(?:[kmbtxKMBTX])?\b", "num"))

# Code points counted as emoji.
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{2B00}-\x{2BFF}\x{FE0F}]"


def normalize_ascii(text) -> Column:
    """Lower case with white space collapsed: the exact form on ASCII texts."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


_HIDDEN = dict.fromkeys(map(ord, "\u200b\u200c\u200d\ufeff"))


@F.udf(StringType(), useArrow=False)
def normalize(s: str | None) -> str | None:
    """Compatibility decomposition without marks and zero-width characters, case-folded, white space collapsed.

    Texts pass in batches of a hundred rows: an Arrow batch would hold ten thousand, of any length, several times over.
    """
    if s is None:
        return None
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return " ".join(s.translate(_HIDDEN).replace("\xa0", " ").casefold().split())


def plain(text) -> Column:
    """Whether a text is null or ASCII."""
    return F.coalesce(F.length(text) == F.octet_length(text), F.lit(True))


def normal_rows(rows: DataFrame, *kept: str) -> DataFrame:
    """(kept, text) with ``normalize`` applied to ``text``; only texts with more than ASCII pass through Python."""
    # Python's split knows four separators as white space that Java's \s leaves out.
    own = F.trim(F.regexp_replace(F.lower("text"), r"[\s\x1c-\x1f]+", " "))
    return rows.filter(plain("text")).select(*kept, own.alias("text")).unionByName(rows.filter(~plain("text")).select(*kept, normalize("text").alias("text")))


def skeletonize(text) -> Column:
    """Template of a normal text: kinds of tokens in place of tokens, other marks as spaces.

    On ASCII the patterns match alike with and without Unicode classes, which take many times as long.
    """
    text = F.col(text) if isinstance(text, str) else text

    def made(unicode: str, kinds) -> Column:
        out = text
        for pattern, kind in kinds:
            out = F.regexp_replace(out, f"{unicode}{pattern}", f" <{kind}> ")
        return F.trim(F.regexp_replace(F.regexp_replace(out, unicode + r"[^\w<>\s]+", " "), unicode + r"\s+", " "))

    return F.when(plain(text), made("", KINDS)).otherwise(made("(?U)", (*KINDS, (EMOJI, "emo"))))


def tokens(text, drop_stopwords: bool = True) -> Column:
    """Words of a normal text; without stopwords and single characters unless told otherwise."""
    found = F.regexp_extract_all(text, F.lit(r"[a-z0-9']+"), 0)
    return F.filter(found, lambda w: ~w.isin(*STOPWORDS) & (F.length(w) > 1)) if drop_stopwords else found


def phrase_hits(text, phrases: tuple[str, ...]) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return sum((text.contains(p).cast("int") for p in phrases[1:]), text.contains(phrases[0]).cast("int"))


def shill_density(text) -> Column:
    """Promotional phrases in a normal text, 0 to 1."""
    return F.least(F.lit(1.0), phrase_hits(text, SHILL) / 3.0)


def conviction_density(text) -> Column:
    """Phrases that show a position in a normal text, 0 to 1."""
    return F.least(F.lit(1.0), phrase_hits(text, CONVICTION) / 2.0)


def effort_score(text, emoji) -> Column:
    """Length, variety and absence of pictures, for normal texts without their ``emoji``, which are counted."""
    words = tokens(text)
    n = F.size(words)
    return F.when(n == 0, 0.0).otherwise(0.5 * F.least(F.lit(1.0), n / 25.0) + 0.3 * F.size(F.array_distinct(words)) / n + 0.2 * (1 - F.least(F.lit(1.0), emoji / n)))


def lexical_diversity(text) -> Column:
    words = tokens(text)
    n = F.size(words)
    return F.when(n < 10, 0.0).otherwise(F.least(F.lit(1.0), F.size(F.array_distinct(words)) / F.sqrt(n.cast("double")) / 10))


def entities(text) -> dict[str, Column]:
    patterns = {"cashtags": r"\$([A-Za-z][A-Za-z0-9]*)", "hashtags": r"#([A-Za-z0-9_]+)", "mentions": r"@([A-Za-z0-9_]+)", "urls": r"(https?://[^\s]+)"}
    return {k: F.regexp_extract_all(text, F.lit(p), 1) for k, p in patterns.items()}


def contains_address(text) -> Column:
    """Word borders by letters and digits of any script: Java's own differ between its versions."""
    pattern = r"0x[0-9a-fA-F]{40}|(?<![\p{L}\p{N}_])[1-9A-HJ-NP-Za-km-z]{32,44}(?![\p{L}\p{N}_])"
    return (F.col(text) if isinstance(text, str) else text).rlike(pattern)


def strip_html(html) -> Column:
    """Tags to spaces, common entities decoded, white space collapsed."""
    out = F.regexp_replace(html, r"<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\n\r]+", " "))


def abbreviated_int(text) -> Column:
    """'1.2K', '3M', '1B' as numbers."""
    number = F.expr(f"try_cast(regexp_extract({text}, '^([0-9.]+)([KMB]?)$', 1) AS DOUBLE)")
    unit = F.regexp_extract(text, "^([0-9.]+)([KMB]?)$", 2)
    return F.rint(number * F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)).cast("long")
