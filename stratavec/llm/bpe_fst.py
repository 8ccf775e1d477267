r"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming UTF-8 decoding.

The merges define, for every byte string w, its encoding T(w). Two facts make T a transducer:

* if k is a token boundary of T(w), then T(w) begins with T(w[:k]) and goes on as T(w[k:]), because
  no merge ever crosses k;
* having read a prefix p, the token of T(w) that covers the next byte begins at some k where
  p[k:] is empty or a proper prefix of a token.

So the tokens that T(p[:k]) share for all such k are in T(w) whatever follows: they can be emitted,
and the rest of p, which is the state, is all that matters. States are made when first reached
(subset construction on demand); each keeps its outgoing arcs (byte -> emitted ids, next state) and
the ids to flush at the end of input. The lookahead is bounded by the longest token.

Decoding maps ids to bytes and runs an incremental UTF-8 automaton whose arcs are composed with the
vocabulary on demand: (state, id) -> (text, state).
"""

from __future__ import annotations

import base64
import functools
import hashlib
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_rows
from .tokenizer import public_path

STATE_LIMIT = 300_000
PIECE_LIMIT = 400_000
NEVER = 1 << 60

#: Fixed value: White_Space of Unicode, which \s means to the encoders of these files.
_SPACE = r"\t-\r \x85\xa0  -     　"
_ODD_SPACE = regex.compile(r"^\s|\s\s|\s$|\x00")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def splitter(pattern: str):
    """The pre-tokenization pattern with White_Space spelt out."""
    spelt = pattern.replace(r"[^\s", "[^" + _SPACE).replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")
    return regex.compile(spelt)


class State:
    __slots__ = ("pending", "arcs", "flush")

    def __init__(self, pending: bytes, flush: tuple[int, ...]):
        self.pending, self.arcs, self.flush = pending, {}, flush


class Transducer:
    """The BPE transducer of a rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.starts = {t[:n] for t in ranks for n in range(1, len(t))}  # proper prefixes of tokens
        self.longest = max(map(len, ranks), default=1)
        self._reset()

    def _reset(self) -> None:
        self.states: dict[bytes, State] = {}
        self.known: dict[bytes, tuple[int, ...]] = {b"": ()}
        self.root = self._state(b"")

    def merged(self, w: bytes) -> tuple[int, ...]:
        """T(w) of a short string by its definition: merge the lowest-ranked pair, leftmost first."""
        found = self.known.get(w)
        if found is None:
            ranks, parts = self.ranks, [w[i:i + 1] for i in range(len(w))]
            pairs = [ranks.get(w[i:i + 2], NEVER) for i in range(len(w) - 1)]
            while pairs and (best := min(pairs)) < NEVER:
                at = pairs.index(best)
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
                del pairs[at]
                if at:
                    pairs[at - 1] = ranks.get(parts[at - 1] + parts[at], NEVER)
                if at < len(pairs):
                    pairs[at] = ranks.get(parts[at] + parts[at + 1], NEVER)
            found = self.known[w] = tuple(ranks[p] for p in parts)
        return found

    def _settled(self, p: bytes) -> tuple[int, ...]:
        """The ids that every continuation of p begins with."""
        common = self.merged(p)
        for k in range(max(0, len(p) - self.longest + 1), len(p)):
            if not common:
                break
            if p[k:] in self.starts:
                other = self.merged(p[:k])
                n = 0
                while n < len(common) and n < len(other) and common[n] == other[n]:
                    n += 1
                common = common[:n]
        return common

    def _state(self, pending: bytes) -> State:
        state = self.states.get(pending)
        if state is None:
            state = self.states[pending] = State(pending, self.merged(pending))
        return state

    def arc(self, state: State, byte: int) -> tuple[tuple[int, ...], State]:
        """The arc of a state for a byte, made when first followed."""
        read = state.pending + bytes((byte,))
        out = self._settled(read)
        rest = read[sum(len(self.bytes_of[i]) for i in out):] if out else read
        found = state.arcs[byte] = (out, self._state(rest))
        return found

    @functools.cached_property
    def bytes_of(self) -> dict[int, bytes]:
        return {i: t for t, i in self.ranks.items()}

    def encode(self, piece: bytes) -> list[int]:
        """T(piece), byte by byte."""
        if len(self.states) > STATE_LIMIT:
            self._reset()
        if len(self.known) > STATE_LIMIT:
            self.known = {b"": ()}
        out, state = [], self.root
        for byte in piece:
            try:
                ids, state = state.arcs[byte]
            except KeyError:
                ids, state = self.arc(state, byte)
            if ids:
                out += ids
        out += state.flush
        return out


class Utf8Decoder:
    """Incremental UTF-8: feed() returns the text that the bytes so far settle, and ill-formed
    sequences become U+FFFD as the Unicode standard recommends (one for each maximal part)."""

    def __init__(self, token_bytes: dict[int, bytes] | None = None):
        self.tokens, self.arcs, self.state = token_bytes or {}, {}, b""

    @staticmethod
    def _need(lead: int) -> tuple[int, int, int]:
        """Continuation bytes of a lead byte (0: ill-formed) and the range of the first of them."""
        if 0xC2 <= lead <= 0xDF:
            return 1, 0x80, 0xBF
        if 0xE0 <= lead <= 0xEF:
            return 2, 0xA0 if lead == 0xE0 else 0x80, 0x9F if lead == 0xED else 0xBF
        if 0xF0 <= lead <= 0xF4:
            return 3, 0x90 if lead == 0xF0 else 0x80, 0x8F if lead == 0xF4 else 0xBF
        return 0, 0, 0

    @classmethod
    def step(cls, held: bytes, byte: int) -> tuple[str, bytes]:
        """One byte of the automaton; a state is the beginning of a character that was read."""
        if not held:
            if byte < 0x80:
                return chr(byte), b""
            return ("", bytes((byte,))) if cls._need(byte)[0] else ("�", b"")
        need, low, high = cls._need(held[0])
        if len(held) > 1:
            low, high = 0x80, 0xBF
        if not low <= byte <= high:
            text, state = cls.step(b"", byte)
            return "�" + text, state
        if len(held) < need:
            return "", held + bytes((byte,))
        code = held[0] & (0x3F >> need)
        for b in held[1:]:
            code = code << 6 | b & 0x3F
        return chr(code << 6 | byte & 0x3F), b""

    @classmethod
    def run(cls, state: bytes, data: bytes) -> tuple[str, bytes]:
        out = []
        for byte in data:
            text, state = cls.step(state, byte)
            out.append(text)
        return "".join(out), state

    def feed(self, ids: Iterable[int]) -> str:
        """The text that these further ids settle."""
        state, arcs, out = self.state, self.arcs, []
        for i in ids:
            found = arcs.get((state, i) if state else i)
            if found is None:
                if len(arcs) > STATE_LIMIT:
                    arcs.clear()
                found = arcs[(state, i) if state else i] = self.run(state, self.tokens[i])
            out.append(found[0])
            state = found[1]
        self.state = state
        return "".join(out)

    def finish(self) -> str:
        """U+FFFD for a character that was begun and not ended; the decoder starts afresh."""
        left, self.state = self.state, b""
        return "�" if left else ""


class Generations(dict):
    """A bounded memo of ``make(text)``: when a generation is full it becomes the old one, whose
    entries are taken over again as they are asked for; older ones go. Long texts are not kept."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, text: str) -> bytes:
        found = self.old.get(text)
        if found is None:
            found = self.make(text)
            if len(text) > 64:
                return found
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[text] = found
        return found


class BpeCodec:
    """Encoding of whole texts and streaming decoding with one rank table and pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.machine = Transducer(ranks)
        self.split = splitter(pattern).findall
        self.decoder = Utf8Decoder(self.machine.bytes_of)
        self.part = Generations(self._part, PIECE_LIMIT // 2).__getitem__
        self.chunk = Generations(self._chunk, PIECE_LIMIT).__getitem__

    def _part(self, part: str) -> bytes:
        """The ids of one match of the pattern, as little-endian unsigned 32-bit integers."""
        ids = array("I", self.machine.encode(part.encode("utf-8")))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.part, self.split(chunk)))

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as little-endian unsigned 32-bit integers.

        A match of the pattern never holds a single space that stands between two other characters
        except as its first character, so texts without other white space runs are first cut there.
        """
        if not text:
            return b""
        if _ODD_SPACE.search(text):
            return self._chunk(text)
        return b"".join(map(self.chunk, text.replace(" ", "\0 ").split("\0")))

    def decode(self, ids: bytes, block: int = 65536) -> Iterator[str]:
        """The text of ids, block by block."""
        for at in range(0, len(ids), 4 * block):
            yield self.decoder.feed(np.frombuffer(ids[at:at + 4 * block], dtype="<u4").tolist())
        yield self.decoder.finish()


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> BpeCodec:
    return BpeCodec(load_ranks(path), pattern)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row (and ids, decoded with ``with_ids``).

    Whole texts are encoded by the transducer and decoded again as a stream; null counts as empty.
    Repeated and null ids are carried along; other columns are not read.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded string" if with_ids else "")
    body = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def work(doc_ids, texts):
        own = codec(ranks_path, pattern)
        for doc_id, text in zip(doc_ids, texts):
            ids = own.encode(text)
            digest, whole = hashlib.sha256(), []
            for part in own.decode(ids):
                digest.update(part.encode("utf-8"))
                if with_ids:
                    whole.append(part)
            more = (np.frombuffer(ids, dtype="<u4").tolist(), "".join(whole)) if with_ids else ()
            yield (doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), digest.hexdigest(), *more)

    return map_rows(body, schema, work)


def round_trip_public(docs: DataFrame, name: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    import public_tokenizers

    return round_trip(docs, public_path(name), public_tokenizers.PATTERN)
