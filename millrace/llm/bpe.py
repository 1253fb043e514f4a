"""Byte-level BPE as a bounded-lookahead streaming transducer, and its incremental decoder.

``Transducer`` takes text in pieces and emits token ids as soon as no later input can change them.

* Pre-tokens. The vocabulary's split pattern is a finite-state scan: a pre-token is closed once the next sign shows
  that it cannot go on. Of an open run only what the pattern may still reclaim is kept.
* Merges inside a pre-token. ``_follows(a, b)`` tells whether two tokens may stand side by side in an encoding (that is,
  encoding their joined bytes gives just those two). An encoding is valid exactly if all its neighbours are, so the
  last token of each prefix's encoding is unique and the encodings of all prefixes form a tree. Only the last
  ``lookahead`` prefixes can be continued, ``lookahead`` being the longest token's length, derived from the merge
  list. What lies before the common ancestor of these prefixes is stable and is emitted. Memory is a window of that
  length, however long the pre-token.

Closed pre-tokens of up to ``MEMO_CHARS`` signs are kept in a memo of bounded size, which only saves time.
``Detokenizer`` is the inverse state machine: bytes that do not yet form a whole sign wait for the next id; invalid
bytes become U+FFFD just as in lossy UTF-8 decoding.

Defined results: null and empty texts have no ids and decode to the empty text; a special token's string in a text
is that one id, as the library does by default; texts of any length are encoded whole, in memory of the ids; repeated
rows are encoded each; merges of one rank are taken from left to right; an empty table gives no rows; other columns than
doc_id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, small_batches, table

#: Pre-tokens in one generation of the memo; two are held.
MEMO_ENTRIES = 350_000
MEMO_CHARS = 48
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_signs() -> dict[str, int]:
    """The printable stand-ins of the byte-level alphabet."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {}, 0
    for b in range(256):
        if b in own:
            out[chr(b)] = b
        else:
            out[chr(256 + extra)] = b
            extra += 1
    return out


class Vocabulary:
    """Tokens as bytes, merge ranks, and the transducer's tables."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        signs = byte_signs()
        self.id_of: dict[bytes, int] = {bytes(signs[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = (bytes(signs[c] for c in t) for t in (pair.split(" ") if isinstance(pair, str) else pair))
            a, b, whole = self.id_of[left], self.id_of[right], self.id_of[left + right]
            self.merge.setdefault((a, b), (rank, whole))
            self.parts.setdefault(whole, (a, b))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.bytes_of = {i: t for t, i in self.id_of.items()} | {i: t.encode() for t, i in self.special.items()}
        self.size = max(self.bytes_of) + 1
        #: Sufficient lookahead in bytes: no merge reaches beyond the longest token that the merge list can build.
        self.lookahead = max(len(self.bytes_of[w]) for w in self.parts) if self.parts else 1
        self.byte = [self.id_of[bytes([b])] for b in range(256)]
        self._pairs: dict[tuple[int, int], bool] = {}

    def merge_all(self, data: bytes) -> list[int]:
        """Plain BPE of a short byte string: the lowest rank first, leftmost among equals."""
        ids, merge = [self.byte[b] for b in data], self.merge
        while len(ids) > 1:
            best, at = None, -1
            for i in range(len(ids) - 1):
                found = merge.get((ids[i], ids[i + 1]))
                if found and (best is None or found[0] < best[0]):
                    best, at = found, i
            if best is None:
                break
            a, b = ids[at], ids[at + 1]
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and ids[i] == a and ids[i + 1] == b:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def follows(self, a: int, b: int) -> bool:
        """Whether b may stand after a in an encoding."""
        known = self._pairs.get((a, b))
        if known is None:
            known = self.merge_all(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
            if len(self._pairs) > MEMO_ENTRIES // 4:
                self._pairs.clear()
            self._pairs[(a, b)] = known
        return known


class Merger:
    """Streams the bytes of one pre-token; ``feed`` gives ids that are stable, ``close`` the rest."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.window = b""
        self.last: list[int | None] = []  # last token of the encoding of each prefix that ends in the window
        self.before: int | None = None  # the emitted token that ends where the window starts

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for b in data:
            self._step(b)
            if len(self.window) >= 3 * self.v.lookahead:
                out += self._stable()
        return out

    def _step(self, b: int) -> None:
        v = self.v
        self.window += bytes([b])
        n = len(self.window)
        for size in range(min(n, v.lookahead), 0, -1):
            token = v.id_of.get(self.window[n - size :])
            if token is None or (size > 1 and token not in v.parts):
                continue
            if size < n:
                left = self.last[n - size - 1]
                if left is None or not v.follows(left, token):
                    continue
            elif self.before is not None and not v.follows(self.before, token):
                continue
            if size > 1 and v.merge_all(self.window[n - size :]) != [token]:
                continue
            self.last.append(token)
            return
        raise AssertionError("every byte is a token, so some token ends here")

    def _path(self, end: int) -> list[int]:
        """Ends of the tokens of the encoding of the prefix that ends at ``end``, backwards."""
        ends = []
        while end > 0:
            ends.append(end)
            end -= len(self.v.bytes_of[self.last[end - 1]])
        return ends

    def _stable(self) -> list[int]:
        n = len(self.window)
        common = None
        for end in range(max(1, n - self.v.lookahead + 1), n + 1):
            ends = set(self._path(end))
            common = ends if common is None else common & ends
        if not common:
            return []
        at = max(common)
        ids = [self.last[e - 1] for e in reversed(self._path(at))]
        self.before = ids[-1]
        self.window, self.last = self.window[at:], self.last[at:]
        return ids

    def close(self) -> list[int]:
        ids = [self.last[e - 1] for e in reversed(self._path(len(self.window)))]
        self.window, self.last, self.before = b"", [], None
        return ids


class Transducer:
    """Text in pieces to ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.split = regex.compile(PATTERN)
        self.special = re.compile("|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None
        self.memo = Memo(lambda s: array("I", self.piece(s)).tobytes())
        self.held = self.tail = ""
        self.open: tuple[Merger, regex.Pattern] | None = None

    # streaming

    def feed(self, piece: str) -> list[int]:
        """Ids that no later text can change. What waits: an open pre-token's end, or a special string's beginning."""
        text, out, at = self.held + piece, [], 0
        for m in self.special.finditer(text) if self.special else ():
            out += self._feed(text[at : m.start()]) + self._close() + [self.v.special[m.group()]]
            at = m.end()
        rest = text[at:]
        n = max((n for word in self.v.special for n in range(1, len(word)) if rest.endswith(word[:n])), default=0)
        self.held = rest[len(rest) - n :]
        return out + self._feed(rest[: len(rest) - n])

    def close(self) -> list[int]:
        text, self.held = self.held, ""
        return self._feed(text) + self._close()

    def _feed(self, piece: str) -> list[int]:
        text, out = self.tail + piece, []
        while True:
            if self.open:
                merger, kind = self.open
                n = kind.match(text).end()
                taken = n - (kind is BLANKS)
                out += merger.feed(text[:taken].encode("utf-8"))
                ended, text = n < len(text), text[taken:]
                if not ended:
                    break
                out += merger.close()
                self.open = None
            cut, waits = 0, ""
            for m in self.split.finditer(text):
                if len(text) - m.start() < 4 or text[m.start() :].isspace():
                    break
                out += array("I", self.memo[waits]) if waits else []
                cut, waits = m.start(), m.group()
            text = text[cut:]
            if len(text) <= MEMO_CHARS:
                break
            lead = text[0] == " " and not text[1].isspace()
            kind = next(k for k in (LETTERS, NUMBERS, BLANKS, OTHERS) if k.match(text, lead).end() > lead)
            if kind.match(text, lead).end() < len(text) or kind is OTHERS and text[0] == "'":
                break
            self.open = Merger(self.v), kind
            out += self.open[0].feed(b" " * lead)
            text = text[lead:]
        self.tail = text
        return out

    def _close(self) -> list[int]:
        text, self.tail = self.tail, ""
        if self.open:
            merger, self.open = self.open[0], None
            return merger.feed(text.encode("utf-8")) + merger.close()
        return array("I", self.raw(text)).tolist()

    # whole texts

    def piece(self, s: str) -> list[int]:
        data = s.encode("utf-8")
        if len(s) <= MEMO_CHARS:
            return self.v.merge_all(data)
        merger = Merger(self.v)
        return merger.feed(data) + merger.close()

    def raw(self, text: str) -> bytes:
        """Ids of a text without special strings, as native unsigned 32-bit integers."""
        found = self.memo.encode(text)
        return self.memo.join(self.split.findall(text)) if found is None else found

    def whole(self, text: str) -> bytes:
        """Ids of a whole text, as native unsigned 32-bit integers."""
        if self.special is None or not self.special.search(text):
            return self.raw(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self.raw(text[at : m.start()]), array("I", [self.v.special[m.group()]]).tobytes()]
            at = m.end()
        return b"".join([*out, self.raw(text[at:])])


LETTERS, NUMBERS, BLANKS, OTHERS = (regex.compile(x) for x in (r"\p{L}*", r"\p{N}*", r"\s*", r"[^\s\p{L}\p{N}]*"))


#: The split pattern spelt out for texts below U+0250, where its classes are these; the standard library's matcher is fast.
_L, _N, _S = r"A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"0-9\u00b2\u00b3\u00b9\u00bc-\u00be", r"\t-\r \u0085\u00a0"
LATIN = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
NOT_LATIN = re.compile("[\u0250-\U0010ffff]")


class Memo(dict):
    """Pre-tokens to bytes of 32-bit ids: a young and an old generation of bounded size before ``encode_piece``."""

    def __init__(self, encode_piece: Callable[[str], bytes]):
        self.encode_piece = encode_piece
        self.old: dict[str, bytes] = {}

    def __missing__(self, s: str) -> bytes:
        ids = self.old.get(s)
        if ids is None:
            ids = self.encode_piece(s)
        if len(s) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[s] = ids
        return ids

    def encode(self, text: str) -> bytes | None:
        """Ids of a text of Latin signs; None for other texts."""
        return None if NOT_LATIN.search(text) else self.join(LATIN.findall(text))

    def join(self, parts: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, parts))


class Detokenizer:
    """Ids to text, one id at a time; holds at most the bytes of one unfinished sign."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes_of = vocabulary.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        get = self.bytes_of.get
        return self.state.decode(b"".join([get(i, b"") for i in ids]))

    def close(self) -> str:
        text = self.state.decode(b"", True)
        self.state.reset()
        return text


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and the decoded text of every document."""
    return _run(docs, path, "doc_id long, ids array<int>, decoded string", lambda doc_id, raw, text: (doc_id, array("I", raw).tolist(), text))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text."""
    return _run(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _digest)


def _digest(doc_id, raw: bytes, text: str) -> tuple:
    return doc_id, len(raw) // 4, hashlib.sha256(little_endian(raw)).hexdigest(), hashlib.sha256(text.encode("utf-8")).hexdigest()


def little_endian(raw: bytes) -> bytes:
    if sys.byteorder == "little":
        return raw
    ids = array("I", raw)
    ids.byteswap()
    return ids.tobytes()


def _run(docs: DataFrame, path: str | None, schema: str, shape: Callable) -> DataFrame:
    small_batches(docs.sparkSession)
    path = path or default_path()

    def load():
        vocabulary = Vocabulary(path)
        coder, back = Transducer(vocabulary), Detokenizer(vocabulary)

        def step(rows: Iterable[tuple]) -> Iterator[tuple]:
            for doc_id, text in rows:
                raw = coder.whole(text or "")
                yield shape(doc_id, raw, back.feed(array("I", raw)) + back.close())

        return step

    return map_rows(docs.select("doc_id", F.col("text").cast("string").alias("text")), schema, load)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, with the digests of the contract."""
    return digests(table(spark, sf_dir, "documents"))
