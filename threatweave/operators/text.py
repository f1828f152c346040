"""Score a corpus of messages with native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatweave.functions.columns import SPACE, any_of, bind, col, strip
from threatweave.functions.fixed import EMAIL_PATTERNS, PHISHING_KEYWORDS, STOP_WORDS, TEXT_PATTERNS

NOT_SPACE = f"[^{SPACE}]"
URL = rf"https?://{NOT_SPACE}+|www\.{NOT_SPACE}+"
EMAIL = rf"{NOT_SPACE}+@{NOT_SPACE}+"
PHONE = rf"\+?\p{{Nd}}[\p{{Nd}}{SPACE}\-()]{{7,}}\p{{Nd}}"
NOT_WORD = rf"[^\p{{L}}\p{{N}}_{SPACE}.!?]"


def scrub_text(text: str | Column) -> Column:
    """Lower case without URLs, addresses, phone numbers and odd signs; "" for NULL."""
    t = F.lower(F.coalesce(col(text), F.lit("")))
    for pattern, put in ((URL, ""), (EMAIL, ""), (PHONE, ""), (NOT_WORD, " "), (f"[{SPACE}]+", " ")):
        t = F.regexp_replace(t, pattern, put)
    return strip(t)


def tokens(scrubbed: Column, stop_words=STOP_WORDS) -> Column:
    """Words that carry meaning: no stop words, lone characters or numbers.

    Words end at blanks and at ``. ! ?``.
    """
    return F.filter(
        F.split(scrubbed, r"[ .!?]+"),
        lambda w: (F.length(w) > 0) & ~w.isin(*stop_words) & ((F.length(w) > 1) | w.isin("a", "i")) & ~w.rlike(r"^\p{Nd}+$"),
    )


def prepare_text(text: str | Column) -> Column:
    """Scrubbed and filtered text, words joined by a blank."""
    return F.array_join(tokens(scrub_text(text)), " ")


def text_patterns(text: str | Column) -> Column:
    """Names of the keyword groups with a hit anywhere in the text."""
    def named(low: Column) -> Column:
        return F.array(*[F.when(any_of(low, words), F.lit(name)) for name, words in TEXT_PATTERNS.items()])

    return F.array_compact(bind(F.lower(F.coalesce(col(text), F.lit(""))), named))


def keyword_hits(text: str | Column) -> Column:
    """Keywords found, in list order with the list's repeats."""
    def hits(low: Column) -> Column:
        return F.array(*[F.when(F.contains(low, F.lit(k)), F.lit(k)) for k in PHISHING_KEYWORDS])

    return F.array_compact(bind(F.lower(F.coalesce(col(text), F.lit(""))), hits))


def email_patterns(text: str | Column) -> Column:
    """Names of the phrase families that occur."""
    t = F.coalesce(col(text), F.lit(""))
    return F.array_compact(F.array(*[F.when(t.rlike("|".join(ps)), F.lit(name)) for name, ps in EMAIL_PATTERNS.items()]))


def text_verdict(df: DataFrame, p: str = "p", threshold: float = 0.35) -> DataFrame:
    prob = F.col(p)
    return df.withColumns(
        {
            "is_phishing": prob >= threshold,
            "prediction": F.when(prob >= threshold, "PHISHING").otherwise("SAFE"),
            "phishing_probability": F.round(prob, 4),
            "risk_score": F.floor(F.least(prob * 100, F.lit(100.0))).cast("int"),
            "confidence": F.round(prob, 2),
        }
    )
