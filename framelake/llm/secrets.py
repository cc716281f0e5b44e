"""Secrets in texts: fixed forms, and random strings that a tokenizer can't compress.

Words of a language fall into few tokens of a vocabulary that was learnt from text; random characters don't. A run of 16 or
more key characters is taken as random if it has few characters a token (2.0 or fewer). A run that isn't as a whole is judged
by its segments between / _ - +: one of 16 or more characters, or neighbours with as many together that begin and end with a random
one; so words joined to a secret don't hide it. Those that meet are one span. Runs and segments that are known digests (hex of a
usual digest's length), UUIDs, or that hold digits alone are left out, as are those that lie within a span found by form.

Kinds, in the order in which spans of one start are listed: assign (a named value), access (an access key id), hex (a long run
of hex digits), random (by token efficiency). A span is the whole match, in code points, its end exclusive.

Defined results: a null or empty text has no spans, and base_sha256 is the digest of the empty string; texts of any length are
scanned whole; repeated rows give repeated results; an empty table gives an empty result. Other columns are never read by the
scan; redact() keeps them as they are.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import release, slices_of, spread, table, texts

KINDS = ("assign", "access", "hex", "random")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
NAMES = ("passw", "secret", "token", "key")  # each name of ASSIGN holds one
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")
CANDIDATE = re.compile("[A-Za-z0-9+/_-]{16,}={0,2}")
SEGMENT = re.compile("[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![A-Za-z0-9])|[A-Za-z0-9=]+")
UUID = re.compile("[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
HEX_RUN = re.compile("[0-9a-f]+|[0-9A-F]+")
DIGESTS = {32, 40, 56, 64, 96, 128}
DIGIT, LETTER, HUMP = re.compile("[0-9]"), re.compile("[A-Za-z]"), re.compile("[a-z][A-Z]")
CHARS_PER_TOKEN = 2.0
#: Bytes of texts whose results a worker holds at once.
SCANNED_BYTES = 4 << 20
SHORTEST = 16

Span = tuple[int, int, int]  # start, kind, end
_encodings: dict[str, tiktoken.Encoding] = {}


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    low = text.lower()
    if any(x in low for x in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def known(run: str) -> bool:
    """Digests and identifiers, which look random but aren't secrets."""
    return bool(HEX_RUN.fullmatch(run) and len(run) in DIGESTS or UUID.fullmatch(run))


def mixed(run: str) -> bool:
    """Digits beside letters, or capitals twice within words."""
    if DIGIT.search(run):
        return bool(LETTER.search(run))
    first = HUMP.search(run)
    return bool(first and HUMP.search(run, first.end()))


class Cover:
    """Tells whether one of some spans holds a given range, in the logarithm of their number."""

    def __init__(self, spans: list[Span]):
        self.starts = [a for a, _, _ in spans]
        self.ends = list(accumulate((b for _, _, b in spans), max))

    def holds(self, a: int, b: int) -> bool:
        k = bisect_right(self.starts, a)
        return k > 0 and self.ends[k - 1] >= b


def random_segments(run: str, encoding: tiktoken.Encoding, chars_per_token: float) -> list[tuple[int, int]]:
    """(start, end) of a run's random parts: neighbouring segments, judged by their own characters and tokens, the signs between them left out.

    Any such neighbours of twice SHORTEST characters or more hold fewer ones that are random, so each start is tried up to these alone.
    """
    parts: list[tuple[int, int, int] | None] = []  # None: nothing goes across
    for m in SEGMENT.finditer(run):
        parts.append(None if known(m.group()) else (*m.span(), len(encoding.encode_ordinary(m.group()))))
    found: list[tuple[int, int]] = []
    for i, first in enumerate(parts):
        if first is None or first[1] - first[0] > chars_per_token * first[2]:
            continue
        chars = tokens = 0
        for j in range(i, len(parts)):
            part = parts[j]
            if part is None or chars >= 2 * SHORTEST:
                break
            a, b, n = part
            chars, tokens = chars + b - a, tokens + n
            if chars >= SHORTEST and b - a <= chars_per_token * n and chars <= chars_per_token * tokens and mixed(run[first[0] : b]):
                if found and first[0] <= found[-1][1]:
                    found[-1] = (found[-1][0], max(b, found[-1][1]))
                else:
                    found.append((first[0], b))
    return found


def random_spans(text: str, taken: list[Span], encoding: tiktoken.Encoding, chars_per_token: float = CHARS_PER_TOKEN) -> list[Span]:
    found: list[Span] = []
    cover = Cover(sorted(taken))
    for m in CANDIDATE.finditer(text):
        run = m.group()
        if not mixed(run) or known(run) or cover.holds(*m.span()):
            continue
        if len(run) <= chars_per_token * len(encoding.encode_ordinary(run)):
            found.append((m.start(), 3, m.end()))
            continue
        for a, b in random_segments(run, encoding, chars_per_token):
            a, b = a + m.start(), b + m.start()
            if not cover.holds(a, b):
                found.append((a, 3, b))
    return found


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The ranks and pattern of a tokenizer, 1 MB as the vocabulary fixes it; read on the driver at path."""
    import public_tokenizers

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return spark.sparkContext.broadcast((ranks, public_tokenizers.PATTERN))


def encoding_of(path: str, sent: Broadcast) -> tiktoken.Encoding:
    if path not in _encodings:
        ranks, pattern = sent.value
        _encodings[path] = tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def all_spans(text: str, encoding: tiktoken.Encoding, chars_per_token: float) -> tuple[list[Span], list[Span]]:
    base = base_spans(text)
    return base, sorted(base + random_spans(text, base, encoding, chars_per_token))


def scan(docs: DataFrame, path: str, *, chars_per_token: float = CHARS_PER_TOKEN) -> DataFrame:
    """The spans of each row of docs, with counts by kind."""
    sent = vocabulary(docs.sparkSession, path)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoding_of(path, sent)
        for whole in rows:
            for batch in slices_of(whole, 1, SCANNED_BYTES):
                counts: list[list[int]] = [[], [], [], []]
                digests, lists = [], []
                for text in batch.column(1).to_pylist():
                    base, spans = all_spans(text, encoding, chars_per_token)
                    for k in range(4):
                        counts[k].append(sum(x[1] == k for x in spans))
                    digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                    lists.append(listed(spans))
                arrays = [batch.column(0), *(pa.array(x, pa.int64()) for x in counts), pa.array(digests, pa.string()), pa.array(lists, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    return texts(docs).mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, path: str, *, mark: str = "[secret]", chars_per_token: float = CHARS_PER_TOKEN) -> DataFrame:
    """docs with each secret in text replaced by mark; a bare digest (hex alone) stays. All other columns stay, and all rows; where docs has n_chars, it is counted anew."""
    sent = vocabulary(docs.sparkSession, path)

    @F.pandas_udf("string")
    def cleaned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = encoding_of(path, sent)

        def clean(text: str | None) -> str | None:
            if not text:
                return text
            _, spans = all_spans(text, encoding, chars_per_token)
            out, at = [], 0
            for a, k, b in spans:
                if (k != 2 or not known(text[a:b])) and b > at:
                    out += [text[at : max(a, at)], mark] if a >= at else []
                    at = b
            return "".join([*out, text[at:]]) if out else text

        for texts_ in batches:
            yield texts_.map(clean, na_action="ignore")
            del texts_
        release()

    out = docs.withColumn("text", cleaned("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), vocabulary_path())
