"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

Each match of the split pattern is encoded separately, so the transducer reads the bytes of one match.  A token sequence
is what the merges give exactly when every two neighbours in it are what the merges give for their joined bytes; then
every prefix of the input has just one sequence, and the open question at any byte is only where the last token began.
A hypothesis is (last finished token, bytes read since, as a node of the trie of all tokens).  A state of the transducer is the set of all hypotheses that some
continuation may still confirm, each with the tokens that the state has not emitted yet.  On a byte, hypotheses whose
bytes no longer begin a token die, one new hypothesis starts where a token ends, and tokens that all survivors share are
emitted.  Hypotheses reach back no further than the longest token, so lookahead and state are bounded.  States and their
transitions are made when first met and kept; the table is dropped when it is full.

Decoding runs the other machine: a state is the unfinished bytes of a UTF-8 character, a token moves it on and emits text.

Cases: a null text is empty and has no tokens; a null document id stays null; repeated rows are encoded each; an empty
table gives no rows; extra columns are ignored.  Texts of any length are read as a whole in linear time.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from whylake.llm.common import table
from whylake.llm.words import Remembered

#: Transducer states, checked pairs and decoder moves kept before their table is dropped.
STATES, PAIRS, MOVES = 200_000, 500_000, 500_000


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """Byte-level BPE of one split piece, a byte at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        #: Tokens that their own merges reach; others occur only as whole pieces.
        steps: dict[bytes, list] = {t: [] for t in ranks}
        self.reachable = {t: r for t, r in ranks.items() if self.merged(t, steps[t]) == [r]}
        #: Trie of these tokens: node * 256 + byte -> node, the root is 0; and the token that ends at a node.
        self.child: dict[int, int] = {}
        self.ends: dict[int, int] = {}
        for token, r in self.reachable.items():
            node = 0
            for byte in token:
                node = self.child.setdefault(node << 8 | byte, len(self.child) + 1)
            self.ends[node] = r
        #: The two tokens that the last merge of a token joins, if the merges of every token go up in rank; otherwise None.
        self.halves = self.last_merges(steps)
        self.compatible: dict[tuple[int, int], bool] = {}
        self.reset()

    def merged(self, data: bytes, steps: list | None = None) -> list[int]:
        """The merges themselves: lowest rank first, leftmost among equals.  ``steps`` takes the rank and the two parts of each."""
        rank, none = self.ranks.get, len(self.ranks) + (1 << 40)
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [rank(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pairs and (best := min(pairs)) != none:
            i = pairs.index(best)
            if steps is not None:
                steps.append((best, parts[i], parts[i + 1]))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], none)
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        known = self.compatible.get((left, right))
        if known is None:
            if len(self.compatible) > PAIRS:
                self.compatible.clear()
            if self.halves is None:
                known = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            else:
                known = self.apart(left, right)
            self.compatible[left, right] = known
        return known

    def last_merges(self, steps: dict[bytes, list]) -> dict[int, tuple[int, int]] | None:
        halves = {}
        for token, rank in self.reachable.items():
            ranks = [s[0] for s in steps[token]]
            if ranks != sorted(ranks) or any(part not in self.reachable for s in steps[token][-1:] for part in s[1:]):
                return None
            if ranks:
                _, left, right = steps[token][-1]
                halves[rank] = self.ranks[left], self.ranks[right]
        return halves

    def apart(self, left: int, right: int) -> bool:
        """Whether no merge crosses the edge of two tokens: theirs are undone, latest first, and the two parts that lie at the
        edge between one merge and the next must not make a token that comes before the next."""
        bytes_of, rank, halves = self.bytes_of, self.ranks.get, self.halves
        none = limit = len(self.ranks) + (1 << 40)
        while rank(bytes_of[left] + bytes_of[right], none) >= limit:
            # of equal ranks the left one is merged first
            if left in halves and (left > right or right not in halves):
                limit, left = left, halves[left][1]
            elif right in halves:
                limit, right = right + 1, halves[right][0]
            else:
                return True
        return False

    def reset(self) -> None:
        start = ((-1, 0, ()),)
        #: Hypotheses of each state: (last finished token or -1, node of the bytes since, tokens not emitted yet).
        self.states: list[tuple] = [start]
        self.number = {start: 0}
        #: Per state: byte -> (emitted tokens, next state), made when first asked for.
        self.moves: list[Moves] = [Moves(self, 0)]

    def step(self, state: int, byte: int) -> tuple[tuple[int, ...], int]:
        """Determinise one transition."""
        child, ends = self.child.get, self.ends.get
        grown, finished = [], None
        for last, since, held in self.states[state]:
            node = child(since << 8 | byte)
            if node is not None:
                grown.append((last, node, held))
                if finished is None:
                    token = ends(node)
                    if token is not None and (last < 0 or self.fits(last, token)):
                        finished = (token, 0, (*held, token))
        grown.append(finished)  # every prefix of the input has a sequence, so there is one
        emitted = grown[0][2]
        common = len(emitted)
        for h in grown:
            while emitted[:common] != h[2][:common]:
                common -= 1
        after = tuple((last, since, held[common:]) for last, since, held in grown) if common else tuple(grown)
        number = self.number.get(after)
        if number is None:
            number = self.number[after] = len(self.states)
            self.states.append(after)
            self.moves.append(Moves(self, number))
        return emitted[:common], number

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > STATES:
            self.reset()
        out: list[int] = []
        state, moves = 0, self.moves
        for byte in piece:
            emitted, state = moves[state][byte]
            if emitted:
                out += emitted
        # the hypothesis that ends a token here is the sequence of the whole piece
        out += next(h[2] for h in self.states[state] if not h[1])
        return out


class Moves(dict):
    """Transitions of one state."""

    __slots__ = ("machine", "state")

    def __init__(self, machine: Transducer, state: int):
        self.machine, self.state = machine, state

    def __missing__(self, byte: int) -> tuple[tuple[int, ...], int]:
        move = self[byte] = self.machine.step(self.state, byte)
        return move


def complete(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


class StreamDecoder:
    """Token ids (as decimal bytes) to text as they come: an incremental UTF-8 machine whose moves are whole tokens."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        #: Moves from "nothing unfinished" back to it.
        self.closed = {str(i).encode(): b.decode() for i, b in bytes_of.items() if complete(b)}
        #: By unfinished bytes: token -> (text, unfinished bytes after it).
        self.moves: dict[bytes, dict[bytes, tuple[str, bytes]]] = {}
        self.known = 0
        self.pending = b""

    def feed(self, ids: list[bytes]) -> str:
        out = list(map(self.closed.get, ids))
        at = 0 if self.pending else self.next_open(out, 0)
        while at < len(out):  # walk from a token that ends inside a character to where the machine is at rest again
            move = self.moves.get(self.pending, {}).get(ids[at]) or self.move(self.pending, ids[at])
            out[at], self.pending = move
            at = at + 1 if self.pending else self.next_open(out, at + 1)
        return "".join(out)

    @staticmethod
    def next_open(texts: list[str | None], begin: int) -> int:
        try:
            return texts.index(None, begin)
        except ValueError:
            return len(texts)

    def move(self, pending: bytes, i: bytes) -> tuple[str, bytes]:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        text = machine.decode(pending + self.bytes_of[int(i)])
        move = text, machine.getstate()[0]
        if self.known < MOVES:
            self.known += 1
            self.moves.setdefault(pending, {})[i] = move
        return move

    def finish(self) -> str:
        """What is left of an unfinished character becomes replacement characters."""
        rest, self.pending = self.pending.decode("utf-8", "replace"), b""
        return rest


@cache
def codec(path: str, pattern: str):
    """(pieces of a text, their ids, decoder) for a vocabulary; made once in a Python worker."""
    import regex

    transducer = Transducer(read_ranks(path))
    encode = transducer.encode

    def ids_of(pieces: list[str]) -> list[bytes]:
        return [",".join(map(str, encode(p.encode()))).encode() for p in pieces]

    return regex.compile(pattern).findall, Remembered(ids_of, 300_000), StreamDecoder(transducer.bytes_of)


def encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text", doc_id: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) and, if asked for, the ids and the decoded text."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    path = path or vocabulary()
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.StringType())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces_of, ids_of, decoder = codec(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                rows = [encode_one(v.as_py() or "", pieces_of, ids_of, decoder, with_ids) for v in part.column(1)]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=schema.fieldNames())

    types = [pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32()), pa.string()] * with_ids
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(of, schema)


def encode_one(text: str, pieces_of, ids_of: Remembered, decoder: StreamDecoder, with_ids: bool) -> tuple:
    line = b",".join(ids_of.each(pieces_of(text)))
    ids = line.split(b",") if line else []
    decoded = decoder.feed(ids) + decoder.finish()
    row = (len(ids), hashlib.sha256(line).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    return (*row, list(map(int, ids)), decoded) if with_ids else row


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), with_ids=False)
