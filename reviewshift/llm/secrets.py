"""Secret scan in DataFrame functions: rules, and sliding-window Shannon entropy.

Rule spans are the leftmost non-overlapping matches of each rule, of which those that fail the
rule's length are dropped. Entropy spans are runs of token characters with a digit whose best
window of ``WINDOW`` characters reaches the threshold of its character class; a run inside a rule
span, or one on the allow-list, adds nothing. Of a run that rule spans cover in part, the pieces
outside them are runs of their own. The window slides one character a step: the counts of the
character that enters and of the one that leaves change by one, and the sum of c*log2(c) changes by
two table lookups, so a run takes time in proportion to its length.

Everything is an expression over one row: no shuffle, no Python. Positions are code points, ends
exclusive. Null texts count as empty and have no spans.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

# Fixed values of the rules: kind, pattern, group that holds the secret, least characters of it.
RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Maximal runs of 20 or more token characters that hold a digit.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
WINDOW, BITS = 20, 5  # characters of a window, and bits that hold a count of them
SPOT = "struct<word:int,by:int,one:bigint>"
#: Character class: pattern of the whole run, bits a character that a window has to reach.
CLASSES = (("hexadecimal", r"^([0-9a-f]+|[0-9A-F]+)$", 3.0),
           ("letters of one case", r"^([0-9a-z+/_=-]+|[0-9A-Z+/_=-]+)$", 3.6),
           ("mixed", r"", 3.8))
#: Runs that are no secrets: UUIDs, documented examples, counting sequences, digits only.
ALLOW = (r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
         r"(?i)example|placeholder|changeme|xxxxxx",
         r"(?i)0123456789|abcdefghij", r"^[0-9+/_=-]+$")
KINDS = tuple(r[0] for r in RULES) + ("entropy",)
SPAN = "struct<start:int,kind:int,end:int>"
CHUNK = 256  # matches over which an array grows step by step


def _chunks(items: Column) -> Column:
    """``items`` (a bound name) in arrays of CHUNK."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(CHUNK)),
                       lambda i: F.slice(items, i + 1, CHUNK))


def _before(values: Column, plus) -> Column:
    """For each of ``values`` (ints of 0 or more) the earlier ones put together by ``plus``, 0
    with none. An array that grows is copied at each step, so it only grows over a chunk of values
    and over the totals of the chunks."""
    def walk(first: Column, own: Column) -> Column:
        return F.aggregate(
            own, F.struct(first.alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, x: F.struct(plus(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
            lambda acc: acc["out"])

    return let(values, lambda v: let(_chunks(v), lambda cs: F.flatten(F.zip_with(
        walk(F.lit(0), F.transform(cs, lambda c: F.aggregate(c, F.lit(0), lambda a, x: plus(a, x)))), cs, walk))))


def _located(text: Column, pattern: str) -> Column:
    """Array of struct(start, m) of the matches of ``pattern``, from the texts between them."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    placed = let(F.arrays_zip(gaps.alias("gap"), found.alias("m")), lambda z: F.zip_with(
        z, _before(F.transform(z, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["m"]), F.lit(0))),
                   lambda a, n: a + n),
        lambda x, at: F.struct((at + F.length(x["gap"])).alias("start"), x["m"].alias("m"))))
    return F.when(text.rlike(pattern), F.filter(placed, lambda x: x["m"].isNotNull())).otherwise(
        F.array().cast("array<struct<start:int,m:string>>"))


def _spans(located: Column, kind: int, keep) -> Column:
    """Array of SPAN of those matches for which ``keep`` holds."""
    return F.transform(F.filter(located, keep), lambda x: F.struct(
        x["start"].alias("start"), F.lit(kind).alias("kind"),
        (x["start"] + F.length(x["m"])).cast("int").alias("end"))).cast(f"array<{SPAN}>")


def rule_spans(text: Column, kind: int) -> Column:
    _, pattern, group, least = RULES[kind]

    def long_enough(x):
        secret = F.regexp_extract(x["m"], pattern, group) if group else x["m"]
        return F.length(secret) >= least

    return _spans(_located(text, pattern), kind, long_enough)


def window_entropy(run: Column) -> Column:
    """Largest Shannon entropy, bits a character, of a window of WINDOW characters of ``run`` (0 for
    a shorter run). The counts of all letters are fields of BITS bits in a few longs, so a step of
    the window changes two of them; the letters are looked up once, as an array."""
    c_log_c = [c * math.log2(c) if c else 0.0 for c in range(WINDOW + 2)]
    gain = F.array(*[F.lit(b - a) for a, b in zip(c_log_c, c_log_c[1:])])  # of one more than c
    number = F.array(*[F.lit(ALPHABET.find(chr(c))) for c in range(128)])
    fields = 63 // BITS
    n_longs = -(-len(ALPHABET) // fields)
    letters = F.transform(F.slice(F.split(run, ""), F.lit(1), F.length(run)), lambda c: F.get(number, F.ascii(c)))
    shifted = lambda how, value, by: F.call_function(how, value, by)

    def spot(letter):
        return F.struct(F.floor(letter / fields).cast("int").alias("word"), (letter % fields * BITS).alias("by"),
                        shifted("shiftleft", F.lit(1).cast("long"), letter % fields * BITS).alias("one"))

    def moves(spots):
        """The letter that enters and the one that leaves (null while the first window fills)."""
        gone = F.concat(F.transform(F.slice(spots, 1, WINDOW), lambda _: F.lit(None).cast(SPOT)),
                        F.slice(spots, 1, F.greatest(F.size(spots) - WINDOW, F.lit(0))))
        return F.zip_with(spots, gone, lambda e, x: F.struct(e.alias("enters"), x.alias("leaves")))

    def held(acc, spot):
        return shifted("shiftright", F.get(acc["counts"], spot["word"]), spot["by"]).bitwiseAND(F.lit((1 << BITS) - 1))

    def step(acc, m):
        e, x = m["enters"], m["leaves"]
        full = x.isNotNull()
        less = held(acc, x) + F.when(e["word"] * 63 + e["by"] == x["word"] * 63 + x["by"], 0).otherwise(-1)
        s = acc["s"] + F.get(gain, held(acc, e).cast("int")) - F.when(full, F.get(gain, less.cast("int"))).otherwise(0.0)
        counts = F.transform(acc["counts"], lambda n, j: n + F.when(j == e["word"], e["one"]).otherwise(F.lit(0).cast("long"))
                             - F.when(full & (j == x["word"]), x["one"]).otherwise(F.lit(0).cast("long")))
        # a letter leaves, so the window before this step was a whole one
        least = F.when(full, F.least(acc["least"], acc["s"])).otherwise(acc["least"])
        return F.struct(counts.alias("counts"), s.alias("s"), least.alias("least"))

    start = F.struct(F.array_repeat(F.lit(0).cast("long"), n_longs).alias("counts"), F.lit(0.0).alias("s"),
                     F.lit(float("inf")).alias("least"))
    best = let(F.transform(letters, spot), lambda spots: F.aggregate(
        moves(spots), start, step, lambda acc: math.log2(WINDOW) - F.least(acc["least"], acc["s"]) / WINDOW))
    return F.when(F.length(run) < WINDOW, 0.0).otherwise(best)


def entropy_spans(text: Column, base: Column) -> Column:
    def keep(x):
        run, kind = x["m"], None
        for _, pattern, bits in reversed(CLASSES):
            kind = F.lit(bits) if kind is None else F.when(run.rlike(pattern), F.lit(bits)).otherwise(kind)
        allowed = F.lit(False)
        for pattern in ALLOW:
            allowed = allowed | run.rlike(pattern)
        return ~allowed & (F.length(run) >= WINDOW) & (window_entropy(run) >= kind)

    def outside(runs):
        blank = masked(text, base, lambda n: F.repeat(F.lit(" "), n))
        own = F.when(F.size(base) == 0, runs).otherwise(let(blank, lambda rest: _located(rest, CANDIDATE)))
        return _spans(own, len(RULES), keep)

    return let(_located(text, CANDIDATE), lambda runs: F.when(F.size(runs) == 0, F.array().cast(f"array<{SPAN}>"))
               .otherwise(outside(runs)))


def scan(docs: DataFrame, text_col: str = "text", base: str = "base_spans", every: str = "spans") -> DataFrame:
    """``docs`` plus two sorted arrays of struct(start, kind, end): rule spans, and all spans.
    Columns of ``docs`` that are called like them are replaced."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.array_sort(F.concat(*[rule_spans(text, k) for k in range(len(RULES))]))
    return (docs.withColumn(base, found)
            .withColumn(every, F.array_sort(F.concat(F.col(base), entropy_spans(text, F.col(base))))))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def masked(text: Column, spans: Column, mask: str | Callable[[Column], Column] = "[secret]") -> Column:
    """``text`` with each stretch that sorted ``spans`` cover replaced by ``mask``, a function of the
    letters that a span adds to those before it or a text for each stretch. A chunk of spans is
    masked within its own stretch of the text, as each cut counts letters from the front."""
    def chunk(c):
        first, last = F.get(c, F.lit(0))["at"], F.element_at(c, -1)
        own = F.substring(text, first + 1, F.greatest(last["at"], last["end"]) - first)
        return let(own, lambda part: F.array_join(F.transform(c, lambda s: F.when(
            s["start"] >= s["at"],
            F.concat(F.substring(part, s["at"] - first + 1, s["start"] - s["at"]), F.lit(mask) if isinstance(mask, str)
                     else mask(s["end"] - s["start"]))).otherwise(
            "" if isinstance(mask, str) else mask(s["end"] - s["at"]))), ""))

    placed = F.zip_with(spans, _before(F.transform(spans, lambda s: s["end"]), F.greatest), lambda s, at: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), at.alias("at")))
    rest = F.array_max(F.transform(spans, lambda s: s["end"]))
    walked = F.concat(let(placed, lambda p: F.array_join(F.transform(_chunks(p), chunk), "")),
                      F.substring(text, rest + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(walked)
