"""Secret scans: three fixed patterns, and a guess-cost bound on the values of credential contexts.

The cost of a value is the least sum of log10 guesses over all ways to cut it into spans that an attacker would try
together: common words (also with look-alike digits), dates, repeats, alphabet runs, keyboard walks, and brute force
over the rest. It is found by dynamic programming over end positions, linear in the value's length. A value that would take ``MIN_GUESSES`` or more
guesses (log10) is reported as a span of kind ``guess``; ordinary words after "token:" cost little and are not.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StructType

from matchframe.llm.text import pieces, release

KINDS = ("assign", "access", "hex", "guess")
#: The three patterns and their least lengths.
ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_MIN, ACCESS_MIN = 12, 18
#: Contexts whose value is priced: a credential word, a separator, and a value up to a blank or quote, however long.
CONTEXT = re.compile(r"""(?<![A-Za-z])(?:password|passwd|passphrase|pwd|secret|token|api_?key|credential|private_?key|access_?key|auth)["']?[ \t]{0,3}(?::|=>|=)[ \t]{0,3}["']?([^\s"']{8,})""", re.I | re.A)
CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "key", "credential", "auth")
#: log10 guesses from which a value counts as a secret.
MIN_GUESSES = 14.0
#: Common words in rough order of frequency; a word's guesses are its place.
WORDS = """password secret token admin login welcome letmein master monkey dragon qwerty abc test example changeme default
guest root user pass key public private access system server database service account hello world love sun moon summer
winter spring autumn shadow football baseball soccer hunter ranger tiger eagle falcon phoenix star light dark fire water
earth wind house home office work school green blue red black white orange purple yellow silver gold company internet
computer network secure security the and for you with this that from have not are was were will your all can has
production staging development local demo sample your_token your_key placeholder redacted none null true false""".split()
RANK = {w: i + 1 for i, w in enumerate(dict.fromkeys(WORDS))}
#: Any other run of letters that could be spoken is a word too, one of ten million.
UNLISTED, UNLISTED_COST = re.compile(r"[A-Za-z]?[a-z]{2,15}|[A-Z]{3,16}"), 7.0
LONGEST = max(map(len, RANK))
KEYBOARD = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("@430!1$57+", "aaeoi" + "l" + "sstt")
PLACE = {c: (y, x + y * 0.5) for y, row in enumerate(KEYBOARD) for x, c in enumerate(row)}
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")


def _alphabet(value: str) -> int:
    n = 10 * any(c.isdigit() for c in value) + 26 * any("a" <= c <= "z" for c in value) + 26 * any("A" <= c <= "Z" for c in value)
    return max(2, n + 33 * any(not c.isalnum() for c in value))


def spans_of(value: str) -> list[tuple[int, int, float, str]]:
    """(start, end, log10 guesses, kind) of every span that is guessed as a whole."""
    low, out, n = value.lower(), [], len(value)
    plain = low.translate(LEET)
    for i in range(n):
        for j in range(i + 3, min(n, i + LONGEST) + 1):
            rank = RANK.get(low[i:j]) or RANK.get(plain[i:j])
            if rank:
                case = 0.0 if value[i:j].islower() else math.log10(2) if value[i:j].isupper() or value[i].isupper() else math.log10(2) * (j - i) / 2
                leet = sum(a != b for a, b in zip(low[i:j], plain[i:j], strict=True)) * math.log10(2) if low[i:j] not in RANK else 0.0
                out.append((i, j, math.log10(rank + 1) + case + leet, "word"))
        if m := DATE.match(value, i):
            out.append((i, m.end(), math.log10(365 * 120 if m.end() - i > 4 else 120), "date"))
    for unit in (1, 2, 3, 4):
        same = 0  # characters from i on that equal the one a unit further
        for i in range(n - unit - 1, -1, -1):
            same = same + 1 if low[i] == low[i + unit] else 0
            j = i + unit + same // unit * unit
            if j - i >= max(3, 2 * unit):
                out.append((i, j, unit * math.log10(_alphabet(value[i : i + unit])) + math.log10((j - i) // unit), "repeat"))
    for m in UNLISTED.finditer(value):
        if 0.2 <= sum(c in "aeiouyAEIOUY" for c in m[0]) / len(m[0]) <= 0.7:
            out.append((*m.span(), UNLISTED_COST, "word"))
    for kind, near, first in (("run", lambda a, b: a.isalnum() and abs(ord(a) - ord(b)) == 1, 36), ("walk", _near, 47)):
        i = 0
        while i < n - 1:
            j = i + 1
            while j < n and near(low[j - 1], low[j]) and (kind == "walk" or j == i + 1 or ord(low[j]) - ord(low[j - 1]) == ord(low[i + 1]) - ord(low[i])):
                j += 1
            if j - i >= 3:
                turns = 0 if kind == "run" else sum(_step(low[k - 1], low[k]) != _step(low[k - 2], low[k - 1]) for k in range(i + 2, j))
                out.append((i, j, math.log10(first * (j - i)) + turns * math.log10(4), kind))
            i = max(i + 1, j - 1)
    return out


def _near(a: str, b: str) -> bool:
    p, q = PLACE.get(a), PLACE.get(b)
    return bool(p and q and a != b and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1)


def _step(a: str, b: str) -> tuple[float, float]:
    return PLACE[b][0] - PLACE[a][0], PLACE[b][1] - PLACE[a][1]


def guess_cost(value: str) -> float:
    """log10 of the guesses that the cheapest segmentation takes."""
    n = len(value)
    each = math.log10(_alphabet(value))
    ending: dict[int, list[tuple[int, float]]] = {}
    for i, j, cost, _ in spans_of(value):
        ending.setdefault(j, []).append((i, cost))
    best = array("d", bytes(8 * (n + 1)))
    for j in range(1, n + 1):
        best[j] = min([best[j - 1] + each, *(best[i] + c for i, c in ending.get(j, ()))])
    return best[n]


def secrets(text: str | None, min_guesses: float = MIN_GUESSES) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, sorted by start, then by the order of KINDS."""
    out: list[tuple[int, int, str]] = []
    if not text:
        return out
    context = ("=" in text or ":" in text) and any(w in low for low in [text.lower()] for w in CONTEXT_WORDS)
    if context:
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
        out += [(*m.span(1), "guess") for m in CONTEXT.finditer(text) if guess_cost(m[1]) >= min_guesses]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_MIN]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def scan(docs: DataFrame, text: str = "text", min_guesses: float = MIN_GUESSES) -> DataFrame:
    """``docs`` with a column ``secret_spans``: array of (start, end, kind); empty for null and empty texts.

    Every row of the input gives one row, repeated rows too. A column of the input called ``secret_spans`` is replaced.
    """
    docs = docs.drop("secret_spans")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text):
            found = [[{"start": s, "end": e, "kind": k} for s, e, k in secrets(t, min_guesses)] for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[*b.schema.names, "secret_spans"])
        release()

    span = StructType().add("start", "integer").add("end", "integer").add("kind", "string")
    schema = StructType([*docs.schema.fields]).add("secret_spans", ArrayType(span))
    return docs.mapInArrow(run, schema)


def mask(docs: DataFrame, text: str = "text", mark: str = "[secret]", min_guesses: float = MIN_GUESSES) -> DataFrame:
    """``docs`` with every secret span of the text replaced by ``mark``; overlapping spans become one mark."""
    return docs.mapInArrow(masking(docs.columns.index(text), text, mark, min_guesses), docs.schema)


def masking(at: int, text: str, mark: str, min_guesses: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches with the texts of column ``at``, called ``text``, masked; a piece of a batch at a time, whatever its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text):
            new = pa.array([masked(t, mark, min_guesses) for t in b.column(at).to_pylist()], b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), new)
        release()

    return run


def masked(text: str | None, mark: str = "[secret]", min_guesses: float = MIN_GUESSES) -> str | None:
    spans = secrets(text, min_guesses)
    if not spans:
        return text
    out, at, open_to = [], 0, -1
    for s, e, _ in spans:
        if s >= open_to:
            out += [text[at:s], mark]
        open_to = at = max(open_to, e)
    return "".join([*out, text[at:]])


def digest(docs: DataFrame) -> DataFrame:
    """Per document: spans of each base kind, the digest of the base spans, and all spans as text.

    One row per input row: doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = secrets(t)
                base = ",".join(f"{k}:{s}:{e}" for s, e, k in found if k != "guess")
                n = [sum(k == kind for *_, k in found) for kind in KINDS]
                rows.append((i, *n, hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for s, e, k in found)))
            types = [pa.int64()] * 5 + [pa.string()] * 2
            names = ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"]
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
        release()

    out = "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, out)
