"""Text normalisation as column expressions.

Built-in expressions throughout; the two pandas UDFs at the end exist for Unicode compatibility forms and for
n-gram sets of long texts, which string slicing would make quadratic.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space in the sense of ECMAScript; Java's own \s is ASCII only.
WS = "[" + "\\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff" + "]"
SPACES = "\t\n\v\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
# Marks that a normalised term does not keep.
TERM_PUNCTUATION = "，。、“”‘’《》（）()［］[]：:；;,.!?！？"
DROPPED = SPACES + TERM_PUNCTUATION
TITLE_PUNCTUATION = "[\\-—–·・:：,，.。\"'“”‘’（）()《》【】［］\\[\\]、<>/]"

# The named entities that are decoded; all others stay as they are.
NAMED_ENTITIES = {"amp": "&", "apos": "'", "gt": ">", "lt": "<", "nbsp": " ", "quot": '"'}

SHORT_TEXT_NOTICE = "短文記事のため、全文相当の引用は表示しません。"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def quote_pattern(text: str) -> str:
    """A literal as a pattern that both Java and RE2 accept."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def alternation(terms: Iterable[str]) -> str:
    return "|".join(quote_pattern(t) for t in terms)


# --- scalar text functions ---------------------------------------------------------------------------------


def trim_u(c: Column | str) -> Column:
    """Trim Unicode white space on both ends."""
    return F.regexp_replace(F.regexp_replace(_col(c), f"^{WS}+", ""), f"{WS}+$", "")


def string_value(c: Column | str) -> Column:
    """Trimmed text, or null when nothing is left."""
    return F.nullif(trim_u(c), F.lit(""))


def norm_term(c: Column | str) -> Column:
    """Text without white space and punctuation. ``translate`` takes one pass where patterns take several."""
    return F.translate(_col(c), DROPPED, "")


def norm_comparable(c: Column | str) -> Column:
    return F.lower(norm_term(c))


def norm_anchor(c: Column | str) -> Column:
    """Normalised term with long dashes as plain ones."""
    return F.translate(_col(c), "—－" + DROPPED, "--")


def decode_entities(c: Column | str) -> Column:
    """One pass over the text: six named entities and numeric ones; anything else is kept."""

    def tokens(text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit("&(?:#x?[0-9a-fA-F]+|[a-zA-Z]+);|[^&]+|&"), F.lit(0))

    def from_code(code: Column, token: Column) -> Column:
        """The character of a code point; a number that is none leaves the entity as it stands."""
        valid = (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(token)

    def decode(token: Column) -> Column:
        body = F.substring(token, 2, 1_000_000_000)
        name = F.regexp_extract(token, "^&([a-zA-Z]+);$", 1)
        # all digits count, after leading zeros; more than eight cannot be a code point
        hexadecimal = F.concat(F.lit("0"), F.regexp_extract(body, "^#x0*([0-9a-fA-F]{0,8});$", 1))
        decimal = F.concat(F.lit("0"), F.regexp_extract(body, "^#0*([0-9]{0,8})(?![0-9])", 1))
        out = F.when(~token.startswith("&"), token)
        for entity, value in NAMED_ENTITIES.items():
            out = out.when(name == entity, F.lit(value))
        out = out.when(body.rlike("^#x0*[0-9a-fA-F]{0,8};$") & (body != "#x;"), from_code(F.conv(hexadecimal, 16, 10).cast("long"), token))
        out = out.when(body.rlike("^#0*[0-9]{0,8}(?![0-9])") & body.rlike("^#[0-9].*;$"), from_code(decimal.cast("long"), token))
        return out.otherwise(token)

    def decoded(text: Column) -> Column:
        return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(tokens(text), decode), "")).otherwise(text)

    return let(_col(c), decoded)


def collapse_ws(c: Column | str) -> Column:
    return trim_u(F.regexp_replace(_col(c), f"{WS}+", " "))


def normalize_ws(c: Column | str) -> Column:
    """Decode entities, then collapse and trim white space."""
    return collapse_ws(decode_entities(c))


MARKUP_TO_SPACE = (
    "(?i)<script\\b[^>]*>[\\s\\S]*?</script>",
    "(?i)<style\\b[^>]*>[\\s\\S]*?</style>",
    "(?i)<br\\s*/?>",
    "(?i)</p>",
    "<[^>]+>",
)


def strip_html(c: Column | str) -> Column:
    text = _col(c)
    for pattern in MARKUP_TO_SPACE:
        text = F.regexp_replace(text, pattern, " ")
    return normalize_ws(text)


def paragraph_text(c: Column | str) -> Column:
    """Text of the non-empty paragraphs; without any, the text of the whole fragment."""
    html = _col(c)
    bodies = F.regexp_extract_all(html, F.lit("(?i)<p\\b[^>]*>([\\s\\S]*?)</p>"), F.lit(1))
    return let(
        F.filter(F.transform(bodies, strip_html), lambda p: p != ""),
        lambda found: F.when(F.size(found) > 0, normalize_ws(F.array_join(found, " "))).otherwise(strip_html(html)),
    )


def excerpt(c: Column | str, max_chars: int = 240) -> Column:
    """Opening of a text: at most ``max_chars``, and never more than 72 % of it."""

    def cut(text: Column) -> Column:
        length = F.length(text)
        keep = F.least(F.lit(max(1, max_chars - 1)), F.greatest(F.lit(48), F.floor(length * 0.72).cast("int")))
        return (
            F.when(length == 0, F.lit(""))
            .when(length < 72, F.lit(SHORT_TEXT_NOTICE))
            .otherwise(F.concat(trim_u(F.substring(text, F.lit(1), keep)), F.lit("…")))
        )

    return let(normalize_ws(c), cut)


def between(c: Column | str, start: str, end: str) -> Column:
    """Text between two markers, null when one is missing."""
    text = _col(c)
    first = F.locate(start, text)
    rest = F.substring(text, first + len(start), F.length(text))
    last = F.locate(end, rest)
    return F.when((first > 0) & (last > 0), F.substring(rest, F.lit(1), last - 1))


def truncate(c: Column | str, max_chars: int, mark: str = "…") -> Column:
    keep = max(0, max_chars - len(mark))
    return let(
        collapse_ws(c),
        lambda text: F.when(F.length(text) <= max_chars, text).otherwise(
            F.concat(trim_u(F.substring(text, 1, keep)), F.lit(mark))
        ),
    )


def contains_any(c: Column | str, cues: Iterable[str]) -> Column:
    cues = tuple(cues)
    return _col(c).rlike(alternation(cues)) if cues else F.lit(False)


def is_in(c: Column | str, values: Iterable[str]) -> Column:
    values = list(values)
    return _col(c).isin(values) if values else F.lit(False)


def clamp(c: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), _col(c)))


def parse_int(c: Column | str) -> Column:
    """The leading integer of a text, null when there is none or when it does not fit an integer."""
    return F.regexp_extract(_col(c).cast("string"), f"^{WS}*([+-]?[0-9]+)", 1).try_cast("int")


def leading_year(title: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_col(title), "^((?:19|20)[0-9]{2})年", 1), F.lit(""))


def year_conflict(left: Column | str, right: Column | str) -> Column:
    left, right = _col(left), _col(right)
    return left.isNotNull() & right.isNotNull() & (left != right)


def shingles(c: Column | str, n: int) -> Column:
    """Set of character n-grams of a short text; texts up to ``n`` long are one gram."""
    chars = F.split(norm_comparable(c), "")
    text = norm_comparable(c)
    grams = F.transform(
        F.sequence(F.lit(1), F.length(text) - (n - 1)),
        lambda i: F.concat(*[F.get(chars, i + (k - 1)) for k in range(n)]),
    )
    return (
        F.when(F.length(text) == 0, F.array().cast("array<string>"))
        .when(F.length(text) <= n, F.array(text))
        .otherwise(F.array_distinct(grams))
    )


# --- pandas UDFs ---------------------------------------------------------------------------------------------


_DROP = str.maketrans("", "", DROPPED)


def _gram_codes(raw: str | None, n: int) -> np.ndarray:
    text = raw.translate(_DROP).lower() if raw else ""
    if not text:
        return np.empty(0, dtype=np.int64)
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    width = min(n, len(points))
    codes = np.full(len(points) - width + 1, width, dtype=np.int64) if width < n else np.zeros(len(points) - n + 1, np.int64)
    for k in range(width):
        codes = (codes << 21) | points[k : len(points) - width + 1 + k]
    return np.unique(codes)


def shingle_codes(c: Column | str, n: int) -> Column:
    """Like :func:`shingles` for texts of any length, each gram packed into one bigint (exact up to n = 3)."""
    if n not in (2, 3):
        raise ValueError("grams of two or three characters fit a bigint")

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def codes(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: _gram_codes(text, n))

    return codes(_col(c))


class SuffixAutomaton:
    """All parts of a text: a state stands for parts that end at the same places. Built and read in time by the length of the texts."""

    def __init__(self, text: str):
        self.moves: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for ch in text:
            state = self._state(self.length[last] + 1, {}, 0)
            while last >= 0 and ch not in self.moves[last]:
                self.moves[last][ch] = state
                last = self.link[last]
            if last >= 0:
                self.link[state] = self._ending(last, ch)
            last = state

    def _state(self, length: int, moves: dict[str, int], link: int) -> int:
        self.moves.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _ending(self, before: int, ch: str) -> int:
        """The state of the part one longer than the longest of ``before``; split off where its state also holds longer parts."""
        found = self.moves[before][ch]
        if self.length[found] == self.length[before] + 1:
            return found
        own = self._state(self.length[before] + 1, self.moves[found].copy(), self.link[found])
        self.link[found] = own
        while before >= 0 and self.moves[before].get(ch) == found:
            self.moves[before][ch] = own
            before = self.link[before]
        return own

    def longest_part(self, text: str) -> str:
        """The longest part of ``text`` that is also one here; of several the leftmost in ``text``."""
        state = size = best = end = 0
        moves, link, length = self.moves, self.link, self.length
        for i, ch in enumerate(text, 1):
            while state and ch not in moves[state]:
                state = link[state]
                size = length[state]
            if ch in moves[state]:
                state = moves[state][ch]
                size += 1
                if size > best:
                    best, end = size, i
        return text[end - best : end]


#: Characters of the texts whose automata a task keeps for the pairs to come.
AUTOMATA_CHARS = 200_000


def longest_common_substring(left: Column | str, right: Column | str) -> Column:
    """Longest text found in both; the leftmost one of the left text on ties.

    Equal texts do not go to Python. For others the right text becomes a suffix automaton, kept while it is asked for again, and the left one is read through it once: time by the sum of both lengths.
    """
    a, b = _col(left), _col(right)

    @F.pandas_udf(T.StringType())
    def common(lefts: pd.Series, rights: pd.Series) -> pd.Series:
        kept: dict[str, SuffixAutomaton] = {}
        chars, found = 0, []
        for x, y in zip(lefts, rights):
            if x is None or y is None:
                found.append(None)
                continue
            if y not in kept:
                if chars > AUTOMATA_CHARS:
                    kept.clear()
                    chars = 0
                kept[y] = SuffixAutomaton(y)
                chars += len(y)
            found.append(kept[y].longest_part(x))
        return pd.Series(found, dtype=object)

    differ = (a != b) & (a != "") & (b != "")
    part = common(F.when(differ, a), F.when(differ, b))
    return F.when(a == b, a).when((a == "") | (b == ""), F.lit("")).otherwise(part)


# Digits of Chinese numerals.
NUMERAL_DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
ORDINAL_PATTERN = "第([一二两三四五六七八九十零〇]{1,4})(?=个|届|次|批|轮|期)"


def ordinal_value(numeral: str) -> int | None:
    """Value of a numeral up to 99; None when it is not written as tens and units."""
    tens, ten, units = numeral.partition("十")
    if not ten:
        return NUMERAL_DIGITS.get(numeral)
    high = NUMERAL_DIGITS.get(tens) if tens else 1
    low = NUMERAL_DIGITS.get(units) if units else 0
    return None if high is None or low is None else 10 * high + low


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def ordinal_digits(c: Column | str) -> Column:
    """Chinese ordinals before a counter word become digits; unreadable ones stay."""
    digits = [d for d in NUMERAL_DIGITS if d not in "零〇两"]
    numerals = list(NUMERAL_DIGITS) + ["十"] + ["十" + d for d in NUMERAL_DIGITS]
    numerals += [a + "十" + b for a in digits + ["两", "零", "〇"] for b in [""] + list(NUMERAL_DIGITS)]
    table = F.create_map(*[F.lit(x) for n in numerals for x in (n, str(ordinal_value(n)))])
    text = _col(c)
    pieces = F.regexp_extract_all(text, F.lit(f"{ORDINAL_PATTERN}|[^第]+|第"), F.lit(0))

    def convert(piece: Column) -> Column:
        return F.when(
            piece.startswith("第") & (F.length(piece) > 1),
            F.concat(F.lit("第"), F.coalesce(F.get(F.array(F.try_element_at(table, F.substring(piece, 2, 9))), F.lit(0)), F.substring(piece, 2, 9))),
        ).otherwise(piece)

    return F.when(text.contains("第"), F.array_join(F.transform(pieces, convert), "")).otherwise(text)


def drop_labels(c: Column | str, labels: Iterable[str]) -> Column:
    """Remove editorial labels in brackets, spaces inside the brackets allowed."""
    labels = tuple(labels)
    if not labels:
        return _col(c)
    spaced = "|".join(f"{WS}*" + f"{WS}*".join(quote_pattern(ch) for ch in label) + f"{WS}*" for label in labels)
    return F.regexp_replace(_col(c), f"[（(](?=[^（）()]{{1,12}}[）)])(?:{spaced})[）)]", "")


def canonical_title(c: Column | str, rules) -> Column:
    """``struct<title, leading_year>``: the form in which two titles are compared for equality."""
    text = nfkc(_col(c))
    for pattern in ("(?i)<br\\s*/?>", "<[^>]+>", "(?i)&nbsp;|&#160;"):
        text = F.regexp_replace(text, pattern, " ")
    labelled = drop_labels(collapse_ws(text), rules.title_labels)
    title = labelled
    for prefix in rules.publisher_prefixes:
        title = F.regexp_replace(title, prefix, "")
    title = ordinal_digits(F.regexp_replace(title, "^(?:19|20)[0-9]{2}年", ""))
    title = F.regexp_replace(F.regexp_replace(title, f"{WS}+", ""), TITLE_PUNCTUATION, "")
    return F.struct(title.alias("title"), leading_year(labelled).alias("leading_year"))
