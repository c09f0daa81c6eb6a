"""Operator 10: secret scans: fixed patterns, and guess-cost dynamic programming for values in a credential context."""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .text import slices, tidy

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
#: Credential contexts beside ASSIGN: a key word and a separator, or user information in an address. The value is the last group,
#: behind a key word its first six characters, which REST goes on from; bare is a separator of spaces alone, as between any two words of prose.
CONTEXT = re.compile(
    r"""(?i:(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[\x20_-]?key|access[\x20_-]?key|private[\x20_-]?key|client[_-]?secret|credentials?|auth(?:orization)?|bearer))["']?(?:\x20*(?:[:=]|=>)\x20*|\x20+is\x20+|(?P<bare>\x20+))(?:bearer\x20+|basic\x20+)?["'`]?([^\s"'`<>,;(){}\[\]]{6})"""
    r"""|[a-zA-Z][a-zA-Z0-9+.-]*://[^\s/:@]+:(?P<address>[^\s/@]{6,})@"""
)
REST = re.compile(r"""[^\s"'`<>,;(){}\[\]]*""")
#: What a text must hold to be looked at more closely: wider than every pattern above, and run by a linear-time engine.
MAYBE = r"""(?i)pass|pwd|secret|token|(?:api|access|private)[\x20_-]?key|credential|auth|bearer|akia|://[^/\s]*:[^\s]*@|[0-9a-f]{24}"""
#: Characters of a repeated block up to which a regular expression looks for it, and that agree beside an anchor of a longer one.
SHORT, GRAM = 24, 8
#: Guesses, in bits, from which a value counts as a secret.
SECRET_BITS = 45.0

# Common words of passwords and placeholders, most common first.
COMMON_WORDS = (
    "password", "admin", "welcome", "login", "secret", "letmein", "changeme", "test", "user", "root", "master", "dragon", "monkey",
    "football", "baseball", "sunshine", "princess", "shadow", "iloveyou", "trustno", "superman", "batman", "hello", "freedom",
    "whatever", "michael", "jordan", "hunter", "summer", "winter", "spring", "autumn", "love", "money", "flower", "cookie", "pepper",
    "ginger", "silver", "golden", "orange", "purple", "yellow", "example", "sample", "dummy", "default", "guest", "demo", "temp",
    "token", "apikey", "key", "your", "here", "my", "the", "foo", "bar", "baz", "none", "null", "true", "false", "undefined",
    "placeholder", "redacted", "hidden", "insert", "enter", "value", "string", "pass", "word", "access", "private", "public", "client",
    "server", "database", "mysql", "postgres", "oracle", "redis", "mongo", "qwerty", "abc", "computer", "internet", "service",
    "account", "system", "super", "power", "magic", "star", "king", "queen", "angel", "baby", "dog", "cat", "horse", "battery",
    "staple", "correct", "blue", "green", "red", "black", "white", "apple", "banana", "house", "secure", "security", "production",
    "staging", "development", "january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
    "november", "december", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
    # words of prose, and parts that longer words are made of; none so short that random letters hold it
    "that", "this", "with", "from", "have", "will", "used", "only", "must", "should", "when", "then", "them", "they", "their", "there",
    "what", "which", "required", "optional", "invalid", "valid", "missing", "expired", "unknown", "empty", "encrypted", "generated",
    "provided", "stored", "shared", "following", "something", "anything", "nothing", "everything", "important", "authentication",
    "authorization", "credential", "management", "manager", "environment", "variable", "variables", "config", "configuration",
    "configured", "application", "information", "different", "username", "email", "name", "number", "letter", "letters", "digit",
    "digits", "character", "characters", "length", "file", "path", "code", "under", "over", "inter", "trans", "counter", "through",
    "stand", "compre", "represent", "present", "communi", "organi", "ation", "ations", "tion", "sion", "ment", "ments", "ness", "less",
    "able", "ible", "ably", "ibly", "ability", "ibility", "ical", "ically", "ings", "ance", "ence", "ally", "ated", "ized", "auto",
    "multi", "self", "semi", "anti", "port", "form", "line", "time", "part", "side", "work", "hand", "head", "land", "life", "ship",
    "book", "room", "water", "school", "heart", "mind", "light", "night", "world", "people", "friend", "family", "child", "children",
    "government", "country", "history",
)
# Keyboard rows and other runs that people type in order.
RUNS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1qaz2wsx3edc4rfv5tgb6yhn7ujm", "abcdefghijklmnopqrstuvwxyz", "01234567890", "qwertzuiop", "azertyuiop")
# Letters that digits and signs stand for.
LEET = str.maketrans({"4": "a", "@": "a", "8": "b", "3": "e", "6": "g", "1": "l", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t", "+": "t", "2": "z"})

_RANK = {w: i + 1 for i, w in enumerate(COMMON_WORDS)}
_LONGEST = max(map(len, COMMON_WORDS))
_NEXT = {a + b for r in RUNS for s in (r, r[::-1]) for a, b in zip(s, s[1:], strict=False)}
_DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:0[1-9]|1[0-2])([-/._]?)(?:0[1-9]|[12]\d|3[01])\3(?:19|20)\d\d|(?:19|20)\d\d")


def _bits_a_char(value: str) -> float:
    kinds = [(r"[a-z]", 26), (r"[A-Z]", 26), (r"[0-9]", 10), (r"[^a-zA-Z0-9]", 33)]
    return math.log2(16 if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) else sum(n for p, n in kinds if re.search(p, value)) or 1)


def _repeats(value: str):
    """(start, end, period) of blocks repeated back to back: the shortest block first up to SHORT characters, longer ones by maximal runs.

    A run of period p > SHORT is a stretch where each character equals the one p on, p long at least. It holds a multiple of p as an
    anchor, beside which GRAM characters agree; anchors are compared by numpy, L log L of them, and only hits are followed out."""
    found = [(m.start(), m.start() + (m.end() - m.start()) // len(m[1]) * len(m[1]), len(m[1])) for m in re.finditer(rf"(.{{2,{SHORT}}}?)\1+", value, re.S)]
    yield from found
    size = len(value)
    if size < 2 * SHORT + 2:
        return
    code = np.frombuffer(value.encode("utf-32-le"), np.uint32).astype(np.uint64)
    gram = np.zeros(size, np.uint64)
    for k in range(GRAM):  # characters past the end count as 0
        gram = gram * np.uint64(0x100000001B3) + np.pad(code[k:], (0, k))
    for period in range(SHORT + 1, size // 2 + 1):
        at = np.arange(0, size - period, period)
        back = np.maximum(at - GRAM, 0)
        known = 0
        for i in at[(gram[at] == gram[at + period]) | (gram[back] == gram[back + period])].tolist():
            if i < known or any(s <= i and i + period <= e and p < period for s, e, p in found):
                continue  # inside a run of this period, or of a shorter one
            end = i
            while end + period < size and value[end] == value[end + period]:
                end += 1
            start = i
            while start > 0 and value[start - 1] == value[start - 1 + period]:
                start -= 1
            known = end
            if end - start >= period:
                found.append((start, end + period, period))
                yield start, start + (end - start + period) // period * period, period


def _spans(value: str):
    """(start, end, bits) of the words, dates, repeats and walks in value; a number of spans linear in its length."""
    low = value.lower()
    plain = low.translate(LEET)
    for at in range(len(value)):
        for end in range(at + 3, min(len(value), at + _LONGEST) + 1):
            rank = _RANK.get(low[at:end])
            swaps = 0
            if rank is None and (rank := _RANK.get(plain[at:end])):
                swaps = sum(a != b for a, b in zip(low[at:end], plain[at:end], strict=True))
            if rank:
                raised = sum(c.isupper() for c in value[at:end])
                case = 0 if not raised else 1 if raised == end - at or value[at].isupper() and raised == 1 else min(raised, end - at - raised) + 1
                yield at, end, math.log2(rank) + case + swaps
        if m := _DATE.match(value, at):
            yield at, m.end(), math.log2(365 * 120 if m.end() - at > 4 else 120) + (2 if m.end() - at > 8 else 0)
    at = 0
    while at < len(value):  # maximal runs of one character
        end = at + 1
        while end < len(value) and value[end] == value[at]:
            end += 1
        if end - at >= 3:
            yield at, end, math.log2(96) + math.log2(end - at)
        at = end
    for start, end, period in _repeats(value):
        yield start, end, guess_bits(value[start : start + period]) + math.log2((end - start) // period)
    at = 0
    while at < len(value):  # maximal walks
        end = at + 1
        while end < len(value) and low[end - 1 : end + 1] in _NEXT:
            end += 1
        if end - at >= 3:
            yield at, end, math.log2(len(RUNS) * 30) + math.log2(end - at) + (1 if value[at:end] != low[at:end] else 0)
        at = max(end, at + 1)


@lru_cache(10_000)
def guess_bits(value: str) -> float:
    """log2 of the guesses of the cheapest segmentation of value into known spans and brute-force spans.

    least[i] is the cost of the first i characters; each known span costs one bit more for where it stands. Time is linear in the
    length but for the bounded span lengths. The empty value costs 0.
    """
    each, ending = _bits_a_char(value), {}
    for at, end, bits in _spans(value):
        ending.setdefault(end, []).append((at, bits))
    least = [0.0] * (len(value) + 1)
    for i in range(1, len(value) + 1):
        least[i] = min([least[i - 1] + each, *(least[at] + bits + 1 for at, bits in ending.get(i, ()))])
    return least[-1]


def scan(text: str, bits: float = SECRET_BITS) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(start, kind, end) of the base spans in order, and (start, end) of the values that guess cost adds (outside base spans)."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    more, at, run, low = [], 0, 0, set()  # run: where the last value's characters end; low: starts of values up to there that cost less
    while m := CONTEXT.search(text, at):
        start, end = m.span(m.lastindex)
        if m["address"] is None and (end := run if start < run else REST.match(text, end).end()) != run:
            run, low = end, set()
        while end > start and text[end - 1] in ".:!?":
            end -= 1
        at = start  # a value may begin with the next key word, or hold it
        # a value less one of three or more repeats at its start costs no more: without this, time would grow with the square of repeats
        if any(start - k in low and text.startswith(text[start - k : start] * 2, start, end) for k in range(1, 25)):
            low.add(start)
            continue
        told = not m["bare"] or re.search(r"[0-9A-Z]", text[start + 1 : end])
        if told and not any(s < end and start < e for s, _, e in base) and guess_bits(text[start:end]) >= bits:
            more.append((start, end))
            at = m.end() if m["address"] else max(run, end)
        elif told and m["address"] is None:
            low.add(start)
    return base, more


def find_secrets(docs: DataFrame, text_col: str = "text", prefix: str = "", bits: float = SECRET_BITS, without: tuple[str, ...] = ()) -> DataFrame:
    """docs (less the columns in without) with n_assign, n_access, n_hex, base_sha256 and spans (names take prefix, so that no column of docs need clash).

    spans lists kind:start:end of all spans by start, in code points, end exclusive; kind `guess` marks what guess cost adds: a
    value in a credential context whose cheapest segmentation takes 2^bits guesses or more. Where nothing but spaces stands between
    the key word and the value, as in prose, the value must also hold a digit or a capital after its first character. base_sha256 digests the fixed-pattern
    spans alone. A value that, less one of three or more repeats at its start, has been found too cheap already is passed over without being
    segmented anew: it can't cost more. Of overlapping spans a base one wins, then the earlier; new columns that clash with a column of docs are
    an error unless prefix parts them. Null and empty texts have no spans. Rows, columns, order within a partition and repeats stay; texts of any length
    are scanned whole, in time linear in their length but for values in a credential context. One narrow pass, no shuffle.
    """
    names = [prefix + c for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")]
    stay = [i for i, c in enumerate(docs.columns) if c not in without]
    text_at, empty = docs.columns.index(text_col), hashlib.sha256(b"").hexdigest()

    def run(batches):
        for whole in batches:
            for batch in slices(whole, whole.schema.names[text_at]):
                texts = batch.column(text_at).cast(pa.string())
                maybe = pc.fill_null(pc.match_substring_regex(texts, MAYBE), False).to_pylist()
                counts, digest, spans = ([], [], []), [], []
                for i, look in enumerate(maybe):
                    base, more = scan(texts[i].as_py(), bits) if look else ((), ())
                    for k in range(3):
                        counts[k].append(sum(x[1] == k for x in base))
                    said = [(s, k, f"{KINDS[k]}:{s}:{e}") for s, k, e in base]
                    digest.append(hashlib.sha256(",".join(x[2] for x in said).encode()).hexdigest() if base else empty)
                    spans.append(",".join(x[2] for x in sorted([*said, *((s, 3, f"guess:{s}:{e}") for s, e in more)])))
                new = [*(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in stay), *new], names=[*(batch.schema.names[i] for i in stay), *names])

    schema = StructType(docs.drop(*without).schema.fields.copy())
    for n, kind in zip(names, ("long", "long", "long", "string", "string"), strict=True):
        schema = schema.add(n, kind)
    return docs.mapInArrow(tidy(run), schema)


def redacted(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", mark: str = "[SECRET]", bits: float = SECRET_BITS) -> DataFrame:
    """docs with every span replaced by mark, and chars_col (if there is one) counted anew for the texts that changed; the same columns."""
    text_at, chars_at = docs.columns.index(text_col), docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches):
        for whole in batches:
            for batch in slices(whole, whole.schema.names[text_at]):
                column = batch.column(text_at)
                maybe = pc.fill_null(pc.match_substring_regex(column.cast(pa.string()), MAYBE), False).to_pylist()
                texts = column.to_pylist()
                chars = batch.column(chars_at).to_pylist() if chars_at is not None else None
                for i in (i for i, look in enumerate(maybe) if look):
                    base, more = scan(texts[i], bits)
                    parts, at = [], 0
                    for s, e in sorted([(s, e) for s, _, e in base] + more):
                        if s >= at:
                            parts += [texts[i][at:s], mark]
                        at = max(at, e)
                    if parts:
                        texts[i] = "".join([*parts, texts[i][at:]])
                        if chars is not None:
                            chars[i] = len(texts[i])
                arrays = list(batch.columns)
                arrays[text_at] = pa.array(texts, column.type)
                if chars is not None:
                    arrays[chars_at] = pa.array(chars, batch.column(chars_at).type)
                yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(tidy(run), docs.schema)


def secrets_by_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col and the columns of find_secrets; texts don't leave the scan."""
    return find_secrets(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")), "__text", without=("__text",))
