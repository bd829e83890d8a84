"""Text cleaning as native Spark Column expressions (no UDFs).

All patterns spell their character classes out so that Java regex (Spark)
and RE2 (the DuckDB oracle) agree with Python's Unicode ``re`` semantics:
``\\w`` -> ``[\\p{L}\\p{N}_]`` and ``\\s`` -> the explicit whitespace set below.
Order of the cleaning chain: lower -> URL -> mention -> hashtag -> emoji ->
character runs -> punctuation runs -> [slang] -> symbols -> whitespace.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx

# Unicode whitespace as Python's str.isspace() defines it.
WS = (r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WORD = r"\p{L}\p{N}_"
# the same set as literal characters, for character-set trims
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
            + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")

URL_RE = rf"https?://[^{WS}]+|www\.[^{WS}]+"
MENTION_RE = rf"@[{WORD}]+"
HASHTAG_RE = rf"#[{WORD}]+"
EMOJI_RE = r"[\x{10000}-\x{10FFFF}\x{2600}-\x{27BF}]+"
RUN_RE = r"([^\n])\1{2,}"
SYMBOL_RE = rf"[^{WORD}{WS}.,!?']"
SPACE_RE = rf"[{WS}]+"
# the same set for Java alone, as one property test a character instead of a dozen ranges
SPACES = r"[\p{IsWhite_Space}\x1C-\x1F]+"
# one pass where the chain names several steps whose matches cannot touch each other
TAG_RE = rf"[@#][a-z0-9{WORD}]+|{EMOJI_RE}"
REPEAT_RE = r"([^\n])\1(?:\1+|(?<=[!?.-]))"
BETWEEN_RE = rf"[^a-z0-9_.,!?'{WORD}]+"
EDGE_SPACE_RE = rf"^[{WS}]+|[{WS}]+$"
DIGITS_RE = r"^\p{Nd}+$"
PUNCT_RUNS: tuple[tuple[str, str], ...] = (
    (r"!{2,}", "!"), (r"\?{2,}", "?"), (r"\.{2,}", "."), (r"-{2,}", "-"),
)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- T1..T10: single steps -------------------------------------------------

def lower(c) -> Column:
    return F.lower(_c(c))


def strip(c) -> Column:
    """Python ``str.strip()``: trims Unicode whitespace on both ends
    (a character-set trim: two linear scans, no regex)."""
    return F.btrim(_c(c), F.lit(WS_CHARS))


def strip_urls(c) -> Column:
    return F.regexp_replace(_c(c), URL_RE, " ")


def strip_mentions(c) -> Column:
    return F.regexp_replace(_c(c), MENTION_RE, " ")


def strip_hashtags(c) -> Column:
    return F.regexp_replace(_c(c), HASHTAG_RE, " ")


def strip_emoji(c, repl: str = " ") -> Column:
    return F.regexp_replace(_c(c), EMOJI_RE, repl)


def collapse_runs(c) -> Column:
    """A character repeated 3+ times becomes one (newlines excepted)."""
    return F.regexp_replace(_c(c), RUN_RE, "$1")


def squeeze_punct(c) -> Column:
    out = _c(c)
    for pat, rep in PUNCT_RUNS:
        out = F.regexp_replace(out, pat, rep)
    return out


def tokens(c) -> Column:
    """Whitespace tokens (Python ``str.split()``), empty pieces dropped."""
    return F.filter(F.split(_c(c), SPACES), lambda k: k != "")


def slang_map(lexicon: dict[str, str] | None = None, whitelist: tuple[str, ...] | None = None) -> dict[str, str]:
    """The lexicon in lower case, without the whitelist."""
    lexicon = lx.SLANG_DICT if lexicon is None else lexicon
    whitelist = lx.DOMAIN_WHITELIST if whitelist is None else whitelist
    wl = {w.lower() for w in whitelist}
    return {k.lower(): v for k, v in lexicon.items() if k and k.lower() not in wl}


def normalize_slang(c, lexicon: dict[str, str] | None = None,
                    whitelist: tuple[str, ...] | None = None, lowered: bool = False) -> Column:
    """Per whitespace token: whitelist keeps, lexicon replaces ("" deletes).

    The key test is an ``IN`` list (hash set after Catalyst's OptimizeIn),
    so the linear map scan only runs for tokens that are in the lexicon.
    ``lowered``: the text is in lower case already.
    """
    lex = slang_map(lexicon, whitelist)
    # no lexicon entry is whitelisted, and array_join leaves nulls out: deleted tokens and the empty edges are null
    mp = F.create_map(F.lit(""), F.lit(None).cast("string"),
                      *[x for k, v in sorted(lex.items()) for x in (F.lit(k), F.lit(v or None).cast("string"))])
    keys = ["", *sorted(lex)]

    def one(k: Column) -> Column:
        lk = k if lowered else F.lower(k)
        return F.when(lk.isin(keys), F.try_element_at(mp, lk)).otherwise(k)

    mapped = F.transform(F.split(_c(c), SPACES), one)
    return F.coalesce(F.array_join(mapped, " "), F.lit(""))


def strip_symbols(c) -> Column:
    return F.regexp_replace(_c(c), SYMBOL_RE, " ")


def squeeze_space(c) -> Column:
    return F.trim(F.regexp_replace(_c(c), SPACES, " "))


def remove_stopwords(c, stoplist: tuple[str, ...] | None = None,
                     keep: tuple[str, ...] = lx.NEGATION_WORDS + lx.INTENSIFIER_WORDS) -> Column:
    """Drop stoplist tokens (minus negations and intensifiers), order kept.

    No stoplist -> identity, which is what the study runs without its
    optional stemmer package.
    """
    if not stoplist:
        return _c(c)
    stop = sorted(set(stoplist) - set(keep))
    if not stop:
        return _c(c)
    return F.array_join(F.filter(F.split(_c(c), " "), lambda k: ~k.isin(stop)), " ")


# --- predicates --------------------------------------------------------------

def token_count(c) -> Column:
    return F.size(tokens(c))


def has_tokens(c, n: int) -> Column:
    """``token_count(c) >= n``, without splitting: the text is read up to its n-th token."""
    if n < 1:
        return token_count(c) >= n
    gap, word = SPACES[:-1], "[^" + SPACES[1:-1]
    return _c(c).rlike(f"^{gap}*+{word}++(?:{gap}++{word}++){{{n - 1}}}")


def is_digits(c) -> Column:
    return _c(c).rlike(DIGITS_RE)


def is_valid_review(c, min_len: int = lx.MIN_TEXT_LENGTH) -> Column:
    """Non-empty, stripped length >= min_len, not all digits."""
    s = strip(c)
    return F.coalesce(_c(c).isNotNull() & (F.length(s) >= min_len) & ~is_digits(s), F.lit(False))


def is_meaningful(c, min_len: int = lx.MIN_TEXT_LENGTH) -> Column:
    """P1 and still >= min_len characters once emoji are removed."""
    seen = rf"[^{EMOJI_RE[1:-2]}{WS}]"
    span = {1: seen}.get(min_len, rf"(?s){seen}(?:{EMOJI_RE[:-1]}*+[^{EMOJI_RE[1:-2]}]){{{max(min_len - 2, 0)}}}.*{seen}")
    # from the first to the last character that is neither emoji nor white space, emoji not counted
    long = _c(c).rlike(span) if min_len > 0 else F.lit(True)
    return F.coalesce(_c(c).isNotNull() & ~is_digits(strip(c)) & long, F.lit(False))


def is_blank(c) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


# --- composed chains -----------------------------------------------------------

def clean_prefix(c) -> Column:
    """Steps shared by both conditions (T1..T7): mentions, hashtags and emoji in one pass, runs of any character and
    of punctuation in another."""
    tags = F.regexp_replace(strip_urls(lower(c)), TAG_RE, " ")
    return F.regexp_replace(tags, REPEAT_RE, "$1")


def clean_suffix(c) -> Column:
    """Symbols and whitespace (T9, T10) in one pass: neither is a word character or kept punctuation."""
    return F.trim(F.regexp_replace(_c(c), BETWEEN_RE, " "))


def _if(c, test) -> Column:
    """``c`` where ``test(c)`` holds, else null; ``c`` is computed once, which a plain ``when`` does not ensure."""
    return F.get(F.filter(F.array(_c(c)), test), F.lit(0))


def clean_text(c, use_normalization: bool = True,
               lexicon: dict[str, str] | None = None,
               whitelist: tuple[str, ...] | None = None) -> Column:
    """Full cleaning; null input -> empty string."""
    p = clean_prefix(c)
    if use_normalization:
        p = normalize_slang(p, lexicon, whitelist, lowered=True)
    return F.coalesce(clean_suffix(p), F.lit(""))


def clean_pipeline(c, use_normalization: bool = True,
                   stoplist: tuple[str, ...] | None = None,
                   min_tokens: int = lx.MIN_TOKEN_COUNT,
                   lexicon: dict[str, str] | None = None,
                   whitelist: tuple[str, ...] | None = None) -> Column:
    """P2 -> T12 -> T11 -> P6; null when rejected."""
    cleaned = remove_stopwords(clean_text(c, use_normalization, lexicon, whitelist), stoplist)
    return finish_pipeline(is_meaningful(c), cleaned, min_tokens)


def finish_pipeline(meaningful, cleaned, min_tokens: int = lx.MIN_TOKEN_COUNT) -> Column:
    return F.when(_c(meaningful), _if(cleaned, lambda x: has_tokens(x, min_tokens)))


def or_plain(cleaned, plain) -> Column:
    """``cleaned``, or ``plain`` where it is empty or null."""
    return F.coalesce(_if(cleaned, lambda x: x != ""), _c(plain))


def clean_with_fallback(c, use_normalization: bool = True,
                        stoplist: tuple[str, ...] | None = None) -> Column:
    """Scoring variant; falls back to lower+strip when rejected."""
    return or_plain(clean_pipeline(c, use_normalization, stoplist), strip(lower(c)))


def changed_by_cleaning(c, use_normalization: bool = True) -> Column:
    """The cleaned text differs from lower+strip of the raw text."""
    return clean_with_fallback(c, use_normalization) != strip(lower(c))


def snippet(c, n: int = 80) -> Column:
    return F.substring(_c(c), 1, n)


DATE_FORMATS = ("yyyy/M/d", "yyyy/M/d H:m:s", "M/d/yyyy", "M/d/yyyy H:m:s", "d MMM yyyy", "d MMMM yyyy",
                "MMM d, yyyy", "MMMM d, yyyy")


def normalize_date(c) -> Column:
    """Parse a timestamp-like string -> yyyy-MM-dd, else null. ISO forms first, then
    DATE_FORMATS in order; of 1/5/2024 the month is the first number."""
    s = _c(c)
    return F.date_format(F.coalesce(F.try_to_timestamp(s), *[
        F.try_to_timestamp(F.trim(s), F.lit(f)) for f in DATE_FORMATS]), "yyyy-MM-dd")
