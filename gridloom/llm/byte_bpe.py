"""Byte-level BPE by a lazily determinised transducer, and streaming decoding by a UTF-8 state machine.

Merging the lowest rank first gives a sequence of tokens in which every two neighbours, merged alone, stay as they
are, and no other sequence of a text's bytes has this property.  So a token may follow another independently of
all before it, and a transducer can read bytes once.  Its nondeterministic state is a set of hypotheses: a
sequence of finished tokens and a place in the trie of tokens for the one being read.  Exactly one hypothesis has
just finished a token.  States of the deterministic machine are such sets; they and their moves are made when a
text first needs them and thrown away when there are too many.  Tokens on which all hypotheses agree are emitted,
which happens within about a token's length; nothing but this lookahead is held back.

Very long texts are cut before a space that a character other than white space follows.  The splitting pattern
always cuts there, whatever stands around, so the parts can be encoded alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import types
from collections.abc import Callable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.text import texts

#: Bounds of what a worker remembers: pieces, the length of one, and states of the transducer.
PIECES, PIECE_CHARS, STATES = 1 << 18, 48, 1 << 17
#: Characters of a text that are split at once.
LONG = 1 << 20
#: Ids that a streaming decoder takes at once.
CHUNK = 1 << 16
CUT = re.compile(r" (?=\S)")
#: A rank above all, and the size of subtrees of the trie that are searched for a token that may come next.
NEVER, FEW = 1 << 40, 16
NODE = itemgetter(2)


def read_ranks(spark: SparkSession, path: str) -> bytes:
    """The lines ``base64 rank`` of a vocabulary file, by Spark where the path names a file system."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}


class Transducer:
    """Encodes one piece of bytes after another; tokens are emitted as little-endian 32-bit ids."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = STATES):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary has all 256 single bytes")
        self.ranks, self.most = ranks, most_states
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.trie: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for t, r in ranks.items():
            node = 0
            for b in t:
                if b not in self.trie[node]:
                    self.trie[node][b] = len(self.trie)
                    self.trie.append({})
                    self.token.append(-1)
                node = self.trie[node][b]
            self.token[node] = r
        self.histories: dict[int, tuple | None] = {}
        self.allowed: dict[int, bool] = {}
        self.below: list[list[int] | None] = [[] for _ in self.trie]
        for node in range(len(self.trie) - 1, -1, -1):  # children have larger numbers
            for child in self.trie[node].values():
                more = self.below[child]
                if self.below[node] is not None:
                    own = [self.token[child]] if self.token[child] >= 0 else []
                    whole = None if more is None else [*self.below[node], *own, *more]
                    self.below[node] = whole if whole is not None and len(whole) <= FEW else None
        self._forget()

    def _forget(self) -> None:
        """Back to the start state, no moves."""
        start = ((-1, (), 0),)
        self.states, self.numbers, self.moves, self.ends = [start], {start: 0}, {}, {}

    def _history(self, token: int) -> tuple[list[tuple[int, bytes, bytes]], bytes, bytes] | None:
        """How merging makes ``token``: rank, first and last part after each merge; None if it makes something else.

        Merging takes the lowest rank first, the leftmost of equals.
        """
        data = self.bytes_of[token]
        parts, steps = [data[i : i + 1] for i in range(len(data))], []
        while len(parts) > 1:
            rank, at = min([(self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))])
            if rank == NEVER:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            steps.append((rank, parts[0], parts[-1]))
        return steps, data[:1], data[-1:]

    def may_follow(self, last: int, token: int) -> bool:
        """Whether ``token`` may stand after ``last``, or first (``last`` = -1).

        Until a merge crosses the border between them, both sides merge as they do alone, whichever has the lower
        rank next; so their histories are replayed side by side.
        """
        key = last << 32 | token
        known = self.allowed.get(key)
        if known is None:
            if len(self.allowed) >= self.most:
                self.allowed.clear()
            known = self.allowed[key] = self._stay_apart(last, token)
        return known

    def _stay_apart(self, last: int, token: int) -> bool:
        for t in (last, token):
            if t >= 0 and t not in self.histories:
                self.histories[t] = self._history(t)
        right = self.histories[token]
        if last < 0 or right is None:
            return right is not None
        left = self.histories[last]
        if left is None:
            return False
        (a, _, x), (b, y, _) = left, right
        rank_of, i, j = self.ranks.get, 0, 0
        next_a, next_b = a[0][0] if a else NEVER, b[0][0] if b else NEVER
        across = rank_of(x + y, NEVER)
        while True:
            if across < next_a and across <= next_b:
                return False
            if next_a <= next_b:
                if next_a == NEVER:
                    return True
                edge = a[i][2]
                i += 1
                next_a = a[i][0] if i < len(a) else NEVER
                if edge is not x:
                    x = edge
                    across = rank_of(x + y, NEVER)
            else:
                edge = b[j][1]
                j += 1
                next_b = b[j][0] if j < len(b) else NEVER
                if edge is not y:
                    y = edge
                    across = rank_of(x + y, NEVER)

    def _open(self, last: int | tuple[int, ...], node: int) -> int | tuple[int, ...] | None:
        """What a hypothesis at ``node`` has to know of the token before it; None if no token below may follow.

        Where few tokens lie below, it is those of them that may follow: the token before has no further say, so
        texts that differ only before it share a state.
        """
        below = self.below[node]
        if below is None:
            return last
        if isinstance(last, tuple):
            return tuple([t for t in last if t in below]) or None
        return tuple([t for t in below if self.may_follow(last, t)]) or None

    def _step(self, state: int, byte: int) -> tuple[int, bytes]:
        """The move from ``state`` on ``byte``: 256 times the next state, and what is emitted."""
        nxt = []
        for last, pending, node in self.states[state]:
            child = self.trie[node].get(byte)
            if child is None:
                continue
            after = self._open(last, child)
            if after is not None:
                nxt.append((after, pending, child))
            t = self.token[child]
            if t >= 0 and (t in last if isinstance(last, tuple) else self.may_follow(last, t)):
                nxt.append((t, (*pending, t), 0))
        first, shared = nxt[0][1], len(nxt[0][1])
        for _, p, _ in nxt:
            while p[:shared] != first[:shared]:
                shared -= 1
        out = np.array(first[:shared], "<u4").tobytes() if shared else b""
        key = tuple([(last, p[shared:], node) for last, p, node in sorted(nxt, key=NODE)])
        number = self.numbers.get(key)
        if number is None:
            if len(self.states) >= self.most:
                self._forget()
                state = -1
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
        move = (number << 8, out)
        if state >= 0:
            self.moves[state << 8 | byte] = move
        return move

    def piece(self, data: bytes) -> bytes:
        """The ids of one piece.  A piece that is a token is that token, reachable by merges or not."""
        whole = self.ranks.get(data)
        if whole is not None:
            return whole.to_bytes(4, "little")
        row, out, moves = 0, [], self.moves.get
        for b in data:
            move = moves(row | b)
            if move is None:
                move = self._step(row >> 8, b)
                moves = self.moves.get
            row, tokens = move
            if tokens:
                out.append(tokens)
        last = self.ends.get(row)
        if last is None:
            done = next(pending for _, pending, node in self.states[row >> 8] if node == 0)
            last = self.ends[row] = np.array(done, "<u4").tobytes()
        return b"".join(out) + last if out else last


class Encoder:
    """Encodes whole texts piece by piece; pieces are remembered while they are few."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.machine, self.find = Transducer(ranks), regex.compile(pattern).findall

        class Known(dict):
            def __missing__(known, piece: str) -> bytes:  # noqa: N805
                got = self.machine.piece(piece.encode())
                if len(piece) <= PIECE_CHARS:
                    if len(known) >= PIECES:
                        known.clear()
                    known[piece] = got
                return got

        self.known = Known()

    def encode(self, text: str) -> bytes:
        ids_of, find = self.known.__getitem__, self.find
        if len(text) <= LONG:
            return b"".join(map(ids_of, find(text)))
        out, at = [], 0
        while at < len(text):
            cut = CUT.search(text, at + LONG)
            end = cut.start() if cut else len(text)
            out.append(b"".join(map(ids_of, find(text[at:end]))))
            at = end
        return b"".join(out)


def _encoder_of(lines: bytes, pattern: str) -> Encoder:
    """The encoder of a worker process, which outlasts a task: functions that travel by value have no module to keep it in."""
    kept = sys.modules.setdefault("_byte_bpe_encoder", types.ModuleType("_byte_bpe_encoder")).__dict__
    key = hashlib.sha256(lines).hexdigest() + pattern
    if kept.get("key") != key:
        kept["encoder"], kept["key"] = Encoder(parse_ranks(lines), pattern), key
    return kept["encoder"]


#: States of the UTF-8 machine: done, one to three bytes to come, and the second bytes that E0, ED, F0 and F4 narrow.
DONE, ONE, TWO, THREE, AFTER_E0, AFTER_ED, AFTER_F0, AFTER_F4, BROKEN = range(9)


def _utf8_moves() -> list[list[int]]:
    moves = [[BROKEN] * 256 for _ in range(9)]

    def put(state: int, first: int, last: int, to: int) -> None:
        for b in range(first, last + 1):
            moves[state][b] = to

    for first, last, to in (
        (0x00, 0x7F, DONE), (0xC2, 0xDF, ONE), (0xE0, 0xE0, AFTER_E0), (0xE1, 0xEC, TWO), (0xED, 0xED, AFTER_ED), (0xEE, 0xEF, TWO),
        (0xF0, 0xF0, AFTER_F0), (0xF1, 0xF3, THREE), (0xF4, 0xF4, AFTER_F4),
    ):
        put(DONE, first, last, to)
    for state, first, last, to in (
        (ONE, 0x80, 0xBF, DONE), (TWO, 0x80, 0xBF, ONE), (THREE, 0x80, 0xBF, TWO),
        (AFTER_E0, 0xA0, 0xBF, ONE), (AFTER_ED, 0x80, 0x9F, ONE), (AFTER_F0, 0x90, 0xBF, TWO), (AFTER_F4, 0x80, 0x8F, TWO),
    ):
        put(state, first, last, to)
    return moves


class StreamDecoder:
    """Takes ids in any chunks and gives back bytes that end with a character; the rest waits.

    Tokens of whole characters leave the machine where it is, so only the others run through it byte by byte.
    Bytes that are no UTF-8 pass as they are and are counted in ``errors``.  Unknown ids raise KeyError.
    """

    def __init__(self, bytes_of: dict[int, bytes], open_tokens: frozenset[int] | None = None):
        self.bytes_of, self.moves = bytes_of, _utf8_moves()
        found = self.open_ids(bytes_of) if open_tokens is None else open_tokens
        self.closed = np.ones(max(bytes_of, default=0) + 1, bool)
        self.closed[list(found)] = False
        self.reset()

    @staticmethod
    def open_ids(bytes_of: dict[int, bytes]) -> frozenset[int]:
        """Tokens that aren't whole characters."""
        moves, out = _utf8_moves(), []
        for t, data in bytes_of.items():
            s = DONE
            for b in data:
                s = moves[s][b]
                if s == BROKEN:
                    break
            if s != DONE:
                out.append(t)
        return frozenset(out)

    def reset(self) -> None:
        self.state, self.held, self.errors = DONE, b"", 0

    def feed(self, ids: np.ndarray) -> bytes:
        data = self.held + b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        waiting, at = len(self.held), -1  # bytes since the last whole character, the token read last
        for i in np.flatnonzero(~self.closed[ids]).tolist():
            if i > at + 1 and self.state != DONE:  # a whole character came amid another
                self.errors, self.state, waiting = self.errors + 1, DONE, 0
            for b in self.bytes_of[int(ids[i])]:
                s = self.moves[self.state][b]
                if s == BROKEN:
                    waiting, s = 0, self.moves[DONE][b]
                    self.errors += (self.state != DONE) + (s == BROKEN)  # the unfinished character, and this byte
                    s = DONE if s == BROKEN else s
                waiting = 0 if s == DONE else waiting + 1
                self.state = s
            at = i
        if at < len(ids) - 1 and self.state != DONE:
            self.errors, self.state, waiting = self.errors + 1, DONE, 0
        self.held = data[len(data) - waiting :] if waiting else b""
        return data[: len(data) - waiting]

    def finish(self) -> bytes:
        """What still waits: a character that never ended."""
        rest, errors = self.held, self.errors + bool(self.held)
        self.reset()
        self.errors = errors
        return rest


def _encoder(lines: bytes, pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder_of(lines, pattern)
        for batch in batches:
            for row, t in texts(batch.column("text"), size=4 << 20):
                ids = [encoder.encode(t.bytes(i).decode("utf-8", "replace")) for i in range(t.n)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, t.n), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], ["doc_id", "ids", "n_tokens"])

    return run


def _decoder(lines: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = None
        for batch in batches:
            if stream is None:
                stream = StreamDecoder({r: t for t, r in parse_ranks(lines).items()})
            others = [c for c in batch.schema.names if c != "ids"]
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                decoded, whole = [], []
                for x in some.column("ids"):
                    ids = np.frombuffer(x.as_py() or b"", "<u4")
                    stream.reset()
                    data = b"".join([stream.feed(ids[i : i + CHUNK]) for i in range(0, len(ids), CHUNK)]) + stream.finish()
                    decoded.append(data)
                    whole.append(not stream.errors)
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in others], some.column("ids"), pa.array(decoded, pa.binary()), pa.array(whole)], [*others, "ids", "decoded", "is_text"])

    return run


def encode(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """doc_id, ids (a binary of little-endian 32-bit numbers) and n_tokens of each row's whole text.

    ``ranks`` are the lines of a vocabulary file, which go to the tasks (a megabyte), ``pattern`` splits texts
    before merging.  Null and empty texts have no ids; bytes that are no UTF-8 count as U+FFFD; every row gives
    a row, other columns aren't read.
    """
    schema = "doc_id " + docs.schema["doc_id"].dataType.simpleString() + ", ids binary, n_tokens long"
    return docs.select("doc_id", "text").mapInArrow(_encoder(ranks, pattern), schema)


def decode(tokens: DataFrame, ranks: bytes) -> DataFrame:
    """``tokens`` with the bytes that ``ids`` stand for, and whether they are UTF-8; null ids give none."""
    others = [c for c in tokens.columns if c != "ids"]
    schema = tokens.select(*others, "ids").schema.add("decoded", "binary").add("is_text", "boolean")
    return tokens.select(*others, "ids").mapInArrow(_decoder(ranks), schema)


def round_trip(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """``decode(encode(docs))`` where tasks hand the ids on within one process."""
    coded, decoded = _encoder(ranks, pattern), _decoder(ranks)
    schema = "doc_id " + docs.schema["doc_id"].dataType.simpleString() + ", n_tokens long, ids binary, decoded binary, is_text boolean"
    return docs.select("doc_id", "text").mapInArrow(lambda batches: decoded(coded(batches)), schema)


def op12_byte_bpe(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """The contract's columns for each row of ``docs``: tokens, and digests of ids and of the decoded bytes.

    ``vocabulary`` is the path of a rank file, by default that of the installed package of public tokenizers.
    A null doc_id stays null, repeated rows give equal rows; null and empty texts have no tokens.
    """
    if vocabulary is None or pattern is None:
        import public_tokenizers

        vocabulary, pattern = vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    ranks = read_ranks(docs.sparkSession, vocabulary)
    coded = round_trip(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), ranks, pattern)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
