"""Text functions: expressions where SQL has them, Arrow-batched functions where it does not."""

from __future__ import annotations

import hashlib
import json
import re
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def canonical_sha256(value) -> str:
    """SHA-256 of JSON with sorted keys, no blanks and unescaped non-ASCII text."""
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode("utf-8", "surrogatepass")).hexdigest()


@F.pandas_udf(StringType())
def message_id(rows: pd.DataFrame) -> pd.Series:
    """``M_`` and 32 digits from (source_id, original_index, source_message_id, sender, time_str, type, content)."""
    names = list(rows.columns)
    return pd.Series(["M_" + canonical_sha256([None if v is None or v != v else (int(v) if n == "original_index" else v) for n, v in zip(names, r, strict=True)])[:32] for r in rows.itertuples(index=False)])


def evidence_id(source_id: str, category: str, payload: dict, grounding: dict) -> str:
    return "E_" + canonical_sha256([source_id, category, payload, grounding])[:32]


def claim_id(source_id: str, kind: str, claim: dict) -> str:
    return "C_" + canonical_sha256([source_id, kind, claim])[:32]


#: Fixed value: the note that stands for what a byte limit has cut.
TRUNCATED = "\n[内容已按提示词预算截断；首尾抽取，存在省略。]"


def limited(text: str, most: int, note: str = TRUNCATED) -> str:
    """Head and tail of a text that together with a note are at most ``most`` UTF-8 bytes, cut between characters.

    The head has half of the room, rounded down, and the tail the rest; a note that fills all the room is cut itself.
    """
    ends = np.cumsum([utf8_size(c) for c in text]) if text else np.zeros(0, int)  # bytes up to the end of each character
    total = int(ends[-1]) if text else 0
    if total <= most:
        return text
    spare = most - sum(map(utf8_size, note))
    if spare <= 0:
        return note[: int(np.searchsorted(np.cumsum([utf8_size(c) for c in note]), max(0, most), "right"))]
    first, last = spare // 2, spare - spare // 2
    return text[: int(np.searchsorted(ends, first, "right"))] + note + text[int(np.searchsorted(ends, total - last, "left")) + 1 :]


def utf8_size(c: str) -> int:
    return 1 + (c >= "\x80") + (c >= "\u0800") + (c >= "\U00010000")


def limit_bytes(c: Column, most: int, note: str = TRUNCATED) -> Column:
    @F.pandas_udf(StringType())
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else limited(x, most, note))

    return f(c)


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def compact(c: Column, most: int = 240) -> Column:
    """One line of at most ``most`` characters, three dots where it was cut; null counts as empty."""
    one = stripped(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\r\n"), F.lit(" ")), F.lit("\n"), F.lit(" ")))
    return F.when(F.char_length(one) <= most, one).otherwise(F.concat(F.regexp_replace(F.substring(one, 1, most), r"\s+$", ""), F.lit("...")))


def head_tail(c: Column, most: int, note: str) -> Column:
    """The first and last half of ``most`` characters around a note."""
    return F.when(F.char_length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most // 2), F.lit(note), F.right(c, F.lit(most // 2))))


def overlapping(text: str, part: str) -> str:
    """SQL: how often ``part`` occurs in ``text``, overlaps counted; 0 for an empty part. One pass over the text."""
    quoted = rf"concat('(?=\\Q', replace({part}, '\\E', '\\E\\\\E\\Q'), '\\E)')"
    return f"CASE WHEN char_length({part}) = 0 OR NOT contains({text}, {part}) THEN 0 ELSE regexp_count({text}, {quoted}) END"


def offsets(text: str, part: str) -> str:
    """SQL: the starts (from 0) of all overlapping occurrences; one search from the last start per occurrence."""
    step = f"locate({part}, {text}, CASE WHEN size(acc) = 0 THEN 1 ELSE element_at(acc, -1) + 2 END) - 1"
    n = overlapping(text, part)
    return f"CASE WHEN ({n}) = 0 THEN cast(array() AS array<int>) ELSE aggregate(sequence(1, {n}), cast(array() AS array<int>), (acc, i) -> concat(acc, array({step}))) END"


def casefold(c: Column) -> Column:
    """Lower case with the letters that have several small forms made one: ß is ss, ς is σ, ſ is s."""
    out = F.lower(c)
    for a, b in (("ß", "ss"), ("ς", "σ"), ("ſ", "s")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_FENCED = re.compile(r"```(?:json)?\s*(.*?)\s*```", re.S | re.I)
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|$)|[{}]', re.S)


def balanced_objects(text: str) -> list[str]:
    """The outermost stretches between braces; braces inside strings don't count."""
    out, depth, first = [], 0, 0
    for m in _TOKEN.finditer(text):
        if m[0] == "{":
            first = m.start() if depth == 0 else first
            depth += 1
        elif m[0] == "}" and depth:
            depth -= 1
            if depth == 0:
                out.append(text[first : m.end()])
    return out


def json_object(text: str) -> str | None:
    """The JSON object in a model's answer: the last fenced block that is one; without a fenced object, the whole text, or else
    the last balanced stretch that is one."""
    tries = [x for x in _FENCED.findall(text)[::-1] if x.startswith("{")]
    for t in tries or [text.strip(), *balanced_objects(text)[::-1]]:
        try:
            if isinstance(json.loads(t), dict):
                return t
        except ValueError:
            continue
    return None


@F.pandas_udf(StringType())
def extract_json(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else json_object(x))


def safe_name(c: Column) -> Column:
    """A file name: nine reserved characters become _, ends are stripped, '' becomes unknown."""
    x = F.regexp_replace(F.trim(F.regexp_replace(c, r'[\\/:*?"<>|]', "_")), r"\.+$", "")
    return F.when(x == "", "unknown").otherwise(x)


def markdown_escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\`*_{}\[\]()#+.!|<>-])", r"\\$1")


def html_escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def idf(total: Column, hits: Column) -> Column:
    return F.log1p(total / F.greatest(F.lit(1), hits))


def markdown_blocks(text: str) -> list[str]:
    """Fences whole, list items and table rows one by one, other lines joined to paragraphs."""
    out, open_, para = [], None, []

    def flush():
        if para:
            out.append("\n".join(para))
            para.clear()

    for row in text.split("\n"):
        if open_ is not None:
            open_.append(row)
            if row.lstrip().startswith("```"):
                out.append("\n".join(open_))
                open_ = None
        elif row.lstrip().startswith("```"):
            flush()
            open_ = [row]
        elif re.match(r"\s*(?:[-*+] |\d+[.)] |\||#)", row):
            flush()
            out.append(row)
        elif row.strip():
            para.append(row)
        else:
            flush()
    if open_ is not None:
        out.append("\n".join(open_))
    flush()
    return out


#: Prose that mentions a time, ids and marks that prose must not hold, references in reports, and digits.
TIME_PROSE = (
    r"\d{4}[-/]\d{1,2}(?:[-/]\d{1,2})?|\d{1,2}:\d{2}|[0-9零〇一二两三四五六七八九十百]+年(?:[0-9一二三四五六七八九十]+月)?|[0-9一二三四五六七八九十]+月[0-9一二三四五六七八九十]+[日号]"
    r"|[0-9零〇一二两三四五六七八九十百半几数]+(?:个半|个多|个|多)?(?:年|日(?!期)|天|周|星期|月|小时|分钟|秒)|次日|翌日|隔天|当晚|当天|同日(?!期)|明天|昨天|后天|前天"
)
FORBIDDEN = r"[<>\n\r]|[EMC]_[0-9a-f]{8,}|P_[0-9]+"
REFERENCE = r"(?<!\w)(?:[EM]_[0-9a-f]{8,32}(?:…|\.{3})?|chunk_\d{1,6})(?!\w)"


def times_named(c: Column) -> Column:
    """The mentions of times in prose, distinct, in order."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?U){TIME_PROSE}"), F.lit(0)))


def unfit_prose(c: Column, most: int = 1200) -> Column:
    """Whether a claim's prose is missing, too long, or holds ids or marks."""
    return F.coalesce(stripped(c) == "", F.lit(True)) | (F.char_length(c) > most) | c.rlike(FORBIDDEN)


def references(c: Column) -> Column:
    """The references in a report, distinct, in order; ``chunk_1/2/3`` stands for three."""
    several = REFERENCE.replace(r"chunk_\d{1,6}", r"chunk_\d{1,6}(?:/\d{1,6})*")
    found = F.regexp_extract_all(c, F.lit(f"(?U){several}"), F.lit(0))
    each = F.transform(found, lambda x: F.when(x.startswith("chunk_"), F.transform(F.split(F.substring(x, 7, 1 << 20), "/"), lambda n: F.concat(F.lit("chunk_"), n))).otherwise(F.array(x)))
    return F.array_distinct(F.flatten(each))


def quoted_missing(prose: str, source: str) -> Column:
    """Whether ``prose`` quotes something that ``source`` (columns) does not contain."""
    found = F.expr(f"flatten(array(regexp_extract_all({prose}, '“([^”]+)”', 1), regexp_extract_all({prose}, '「([^」]+)」', 1), regexp_extract_all({prose}, '\"([^\"]+)\"', 1)))")
    return F.exists(found, lambda q: ~F.contains(F.col(source), q))


def level_from_words(text: Column, words: dict[int, list[str]]) -> Column:
    """The level whose words occur most often, null on a tie or without any."""
    count = lambda w: F.expr("0") if not w else (F.char_length(text) - F.char_length(F.replace(text, F.lit(w), F.lit("")))) / len(w)
    sums = F.array(*[F.struct(sum((count(w) for w in ws), F.lit(0.0)).alias("n"), F.lit(level).alias("level")) for level, ws in sorted(words.items())])
    best = F.array_max(F.transform(sums, lambda s: s["n"]))
    top = F.filter(sums, lambda s: s["n"] == best)
    return F.when((best > 0) & (F.size(top) == 1), top[0]["level"])


class Trigrams(NamedTuple):
    """Trigrams of some texts: ``names`` in order; trigram k has the postings ``first[k]`` up to ``first[k + 1]``, posting i is
    of text ``rows[i]`` and has the ``places`` (from 0) ``starts[i]`` up to ``starts[i + 1]``. ``lengths``: each text's trigrams."""

    names: list[str]
    first: np.ndarray
    rows: np.ndarray
    starts: np.ndarray
    places: np.ndarray
    lengths: np.ndarray


def trigrams(texts: list[str]) -> Trigrams:
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.array([len(t) for t in texts], np.int64)
    lengths = np.maximum(sizes - 2, 0)
    row = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = (np.cumsum(sizes) - sizes)[row] + place
    code = chars[at] << np.uint64(42) | chars[at + 1] << np.uint64(21) | chars[at + 2]
    order = np.argsort(code, kind="stable")
    code, row, place = code[order], row[order], place[order]
    other = np.ones(len(code), bool)
    other[1:] = code[1:] != code[:-1]
    new = other.copy()
    new[1:] |= row[1:] != row[:-1]
    starts = np.flatnonzero(new)
    first = np.append(np.flatnonzero(other[starts]), len(starts))
    known = code[starts[first[:-1]]]
    text = np.stack([known >> np.uint64(42), known >> np.uint64(21) & np.uint64((1 << 21) - 1), known & np.uint64((1 << 21) - 1)], axis=1).astype("<u4").tobytes().decode("utf-32-le")
    return Trigrams([text[k : k + 3] for k in range(0, len(text), 3)], first, row[starts], np.append(starts, len(code)), place, lengths)
