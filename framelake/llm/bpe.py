"""Byte-pair encoding by longest matches and backtracking, and decoding by an offset table.

A word's exact merge result is the one sequence of tokens whose neighbours are all compatible: a pair is compatible if
merging its two strings side by side would leave the border between them. The encoder walks the word once. It takes the
longest token that an Aho-Corasick automaton finds at the current place; where that token doesn't fit the one before, it
tries the token's longest proper prefix that is a token, then its next one; where none fits, it drops the last token and
marks the place as a dead end, so that no place is left twice by the same way and the time is linear in the word.

A worker holds a bounded part of its batch: texts are taken by their bytes, and a long one is encoded and decoded in pieces that
end before white space, which no token spans; its digests are made piece by piece. Words and pairs of tokens are remembered up to a
bound, and from task to task; a lean worker remembers fewer, and nothing after a task, which takes more time.

Defined results: a null text counts as empty; an empty text has no tokens, and its decoded text is empty; a text of any
length is encoded whole, word by word; strings of the vocabulary's special tokens in a text become these tokens. Rows are
independent of one another, so repeated rows give repeated results, and an empty table gives an empty result. Other
columns of the input are never read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from framelake.llm.common import release, slices_of, spread, table, texts

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Pieces of text whose tokens a worker remembers, in each of two generations; a lean one. As many and more pairs of tokens.
REMEMBERED = 400_000
LEAN = 50_000
PAIRS = 150_000
#: Bytes of texts whose results a worker holds at once, and characters of a text that it encodes at once.
HELD_BYTES = 1 << 20
PIECE = 1 << 18
END = "</w>"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(plain))
    return letters


class WordVocabulary:
    """A vocabulary with word ends. Inside, a token is a string of symbols: chr(byte), or chr(256 + byte) at a word's end."""

    def __init__(self, definition: dict):
        model = definition["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END or model.get("continuing_subword_prefix"):
            raise ValueError("expected a BPE vocabulary with word ends")
        vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in definition["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.names = [""] * size
        for name, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = name
        self.symbols: list[str] = [""] * size
        self.parts = [(i, i) for i in range(size)]
        self.rank = [-1] * size
        inner: dict[str, str] = {}
        for b, letter in byte_letters().items():
            for name, symbol in ((letter, chr(b)), (letter + END, chr(256 + b))):
                inner[name] = symbol
                self.symbols[vocab[name]] = symbol
        self.merged: dict[tuple[int, int], int] = {}
        for k, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            i = vocab[left + right]
            if self.rank[i] >= 0:
                raise ValueError(f"two merges make {left + right!r}")
            inner[left + right] = self.symbols[i] = inner[left] + inner[right]
            self.parts[i], self.rank[i] = (vocab[left], vocab[right]), k
            self.merged[vocab[left], vocab[right]] = i
        self.of = {s: i for i, s in enumerate(self.symbols) if s}
        for s in [s for s, i in self.of.items() if len(s) > 1 and self.by_merging(s) != [i]]:
            del self.of[s]  # merging never makes it, so neither may matching
        self.shorter = [next((self.of[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.of), -1) for s in self.symbols]

    def by_merging(self, word: str) -> list[int]:
        """The definition: merge the leftmost pair of lowest rank until none is left."""
        ids = [self.of[c] for c in word]
        while len(ids) > 1:
            found = [(self.rank[m], k) for k, p in enumerate(zip(ids, ids[1:])) if (m := self.merged.get(p)) is not None]
            if not found:
                break
            k = min(found)[1]
            ids[k : k + 2] = [self.merged[ids[k], ids[k + 1]]]
        return ids


class Encoder:
    """Built from the driver's vocabulary, in less than a tenth of a second; words and compatible pairs are remembered."""

    def __init__(self, vocabulary: WordVocabulary, remembered: int = REMEMBERED):
        v = self.v = vocabulary
        self.remembered = remembered
        self.automaton = ahocorasick.Automaton()
        for s, i in v.of.items():
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self.size = [len(s) for s in v.symbols]
        self.pairs: dict[int, bool] = {}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.words = Words(self.run)
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(v.special, key=len, reverse=True))) + ")") if v.special else None
        self.last = {chr(b): chr(256 + b) for b in range(256)}
        spelled = [name.encode() + b" " for name in v.names]
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in spelled])]).astype(np.int64)
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging keeps the border between two tokens; answers are remembered in the pair table."""
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS + self.remembered:
                self.pairs.clear()
            known = self.pairs[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        """Undo the later of the two tokens' merges again and again: no pair at the border may have merged earlier."""
        v = self.v
        before = len(v.names)  # merges of a rank from here on come too late to join the two
        while True:
            joined = v.merged.get((left, right))
            if joined is not None and v.rank[joined] < before:
                return False
            a, b = v.rank[left], v.rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:  # the left one was made last: before that, its right part stood at the border
                before, left = a, v.parts[left][1]
            else:  # while the right one was made, an equal merge at the border would have been further left, so first
                before, right = b + 1, v.parts[right][0]

    def word(self, symbols: str) -> list[int]:
        """Tokens of one word of symbols."""
        whole = self.v.of.get(symbols)
        if whole is not None:
            return [whole]
        ids: list[int] = []
        known, last = self.pairs.get, -1
        for end, token in self.automaton.iter_long(symbols):
            if last >= 0:
                fits = known(last << 20 | token)
                if fits is None:
                    fits = self.compatible(last, token)
                if not fits:
                    return self.by_backtracking(symbols, ids, end + 1 - self.size[token], token)
            ids.append(token)
            last = token
        return ids

    def by_backtracking(self, symbols: str, ids: list[int], at: int, token: int) -> list[int]:
        """ids fit one another and end at the place at, where token is the longest match."""
        size, shorter, known, longest, n = self.size, self.v.shorter, self.pairs.get, self.automaton.iter_long, len(symbols)
        open_ = bytearray(b"\1") * (n + 1)
        while True:
            last = ids[-1] if ids else -1
            while token >= 0:
                end = at + size[token]
                if open_[end]:
                    if last < 0:
                        break
                    fits = known(last << 20 | token)
                    if fits or fits is None and self.compatible(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                at = end
                if at == n:
                    return ids
                token = next(longest(symbols, at))[1]
            else:
                open_[at] = 0
                token = ids.pop()
                at -= size[token]

    def piece(self, piece: str) -> bytes:
        """Ids of one piece, as little-endian unsigned 32-bit integers."""
        symbols = piece if piece.isascii() else piece.encode("utf-8", "surrogatepass").decode("latin-1")
        return array("I", self.word(symbols[:-1] + self.last[symbols[-1]])).tobytes()

    def run(self, part: str) -> bytes:
        """Ids of a run without special tokens."""
        if not part.isascii():
            part = unicodedata.normalize("NFC", part).replace("\u03a3", "\u03c3")  # lower() goes letter by letter, without a final sigma
        part = part.lower()
        new, old, out = self.new, self.old, []
        for piece in (ANY if UNUSUAL.search(part) else USUAL).findall(part):
            x = new.get(piece)
            if x is None:
                x = old.get(piece)
                if x is None:
                    x = self.piece(piece)
                if len(piece) < 100:
                    new[piece] = x
                    if len(new) >= self.remembered:
                        self.old, self.new = old, new = new, {}
            out.append(x)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian unsigned 32-bit integers. No piece spans white space."""
        if self.split_special and "<" in text and self.split_special.search(text):
            parts = self.split_special.split(text)
            return b"".join(array("I", [self.v.special[x]]).tobytes() if k % 2 else self.run(x) for k, x in enumerate(parts))
        if ODD.search(text):
            return self.run(text)
        words = self.words
        if len(words) >= self.remembered:
            words.clear()
        return b"".join([words[w] for w in text.split()])

    def decode(self, ids: np.ndarray) -> bytes:
        """Spellings by the offset table, a space between two."""
        if not len(ids):
            return b""
        begin = self.offsets[ids]
        length = self.offsets[ids + 1] - begin
        end = np.cumsum(length)
        return self.spelled[np.repeat(begin - (end - length), length) + np.arange(end[-1])][:-1].tobytes()


_SHORT = "'s|'t|'re|'ve|'m|'ll|'d|"
#: The vocabulary's own split, and the same for texts of ASCII and Latin-1 letters alone, where the standard library is faster.
ANY = regex.compile(_SHORT + r"[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
USUAL = re.compile(_SHORT + "[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\t-\r a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
UNUSUAL = re.compile("[^\x00-\x7f\u00df-\u00f6\u00f8-\u00ff]")
#: str.split() splits at these too, though they are no white space of Unicode.
ODD = re.compile("[\x1c-\x1f]")


class Words(dict):
    """Ids of runs without white space."""

    def __init__(self, run):
        self.run = run

    def __missing__(self, word: str) -> bytes:
        x = self.run(word)
        if len(word) < 100:
            self[word] = x
        return x


SPACE = re.compile("[\t\n\r ]")
_encoders: dict[str, Encoder] = {}


def load(path: str) -> WordVocabulary:
    with open(path, encoding="utf-8") as f:
        return WordVocabulary(json.load(f))


def pieces_of(text: str, size: int = PIECE) -> Iterator[str]:
    """text in parts of about size characters, each but the first from white space on; a run without white space stays whole."""
    at = 0
    while len(text) - at > size:
        cut = max(text.rfind(" ", at, at + size), text.rfind("\n", at, at + size))
        if cut <= at:
            found = SPACE.search(text, at + size)
            if not found:
                break
            cut = found.start()
        yield text[at:cut]
        at = cut
    yield text[at:]


def encode_documents(docs: DataFrame, path: str, *, with_ids: bool = False, with_text: bool = False, lean: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids array<int>][, decoded string]) of each row of docs.

    The vocabulary is read on the driver at path and sent to the workers: a size that the vocabulary fixes, about 2 MB.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(load(path))
    schema = SCHEMA + ", ids array<int>" * with_ids + ", decoded string" * with_text

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, batch, part = _encoders.get(path), None, None
        if lean or encoder is None:
            encoder = Encoder(sent.value, LEAN if lean else REMEMBERED)
            if not lean:
                _encoders[path] = encoder
        for batch in rows:
            for part in slices_of(batch, 1, HELD_BYTES):
                yield settle(encoder, part)
        del encoder, batch, part  # the worker's next task may need the memory
        release()

    def settle(encoder: Encoder, part: pa.RecordBatch) -> pa.RecordBatch:
        counts, of_ids, of_text = [], [], []
        kept, spelled = [], []
        for text in part.column(1).to_pylist():
            n, ids_digest, text_digest, own = 0, hashlib.sha256(), hashlib.sha256(), []
            for piece in pieces_of(text):
                raw = encoder.encode(piece)
                decoded = encoder.decode(np.frombuffer(raw, np.uint32).astype(np.int64))
                if n and decoded:
                    decoded = b" " + decoded
                n += len(raw) // 4
                ids_digest.update(raw)
                text_digest.update(decoded)
                if with_ids:
                    kept.append(raw)
                if with_text:
                    own.append(decoded)
            counts.append(n)
            of_ids.append(ids_digest.hexdigest())
            of_text.append(text_digest.hexdigest())
            if with_text:
                spelled.append(b"".join(own).decode("utf-8", "replace"))
        columns = {"doc_id": part.column(0), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_text, pa.string())}
        if with_ids:
            ids = pa.Array.from_buffers(pa.int32(), sum(counts), [None, pa.py_buffer(b"".join(kept))])
            columns["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), ids)
        if with_text:
            columns["decoded"] = pa.array(spelled, pa.string())
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return texts(docs).mapInArrow(run, schema)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), vocabulary_path())
