"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

Every prefix of a piece has one encoding, and the prefix up to any token border
of it is encoded by the tokens before that border.  So the encoding of a prefix
is known from its last token alone, and the last token of a longer prefix is the
one vocabulary entry at its end that may follow the token before it.

A border is alive while some vocabulary entry starts with the bytes behind it.
A state of the transducer is the bytes behind each alive border and the token
before it; of that token only the right edge can merge with what follows, so it
stands for all that end in the same way as far as the bytes read allow a merge.
An arc says which token ends at the byte read.  The ways back from the alive
borders meet after a bounded number of bytes, and the tokens before that place
are emitted.  States and arcs are made when a text first needs them and kept for
the next one.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import chain

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kotonoha.llm.common import map_rows

#: Arcs that a task remembers before it starts over, about 250 bytes each, and pairs of tokens, about 200 each.
ARCS, FOLLOWS = 500_000, 250_000

#: Beginnings of pieces whose states a task remembers, and their bytes.
HEADS, HEAD = 100_000, 5

#: What tokens do in states of the decoder, remembered by a task.
MOVES = 200_000

#: Bytes of the chunks that a task remembers in either of two tables, and those of one besides its text.
CHUNK_BYTES, CHUNK_COST = 80 << 20, 280

#: Bytes of a piece that a task remembers for the chunks it stands in, besides its ids.
PIECE_COST = 150


def load_ranks(path: str) -> dict[bytes, int]:
    """The entries of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


def beginnings(ranks: dict[bytes, int]) -> set[bytes]:
    """What tokens begin with, without whole tokens."""
    return {token[:n] for token in ranks for n in range(1, len(token))}


class Transducer:
    """Bytes of a piece in, ids out."""

    def __init__(self, ranks: dict[bytes, int], arcs: int = ARCS, starts: set[bytes] | None = None):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.ranks, self.most, self.worst = ranks, arcs, max(ranks.values()) + 1
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self.ahead = 4 * max(self.length.values())
        self.starts = beginnings(ranks) if starts is None else starts
        self.follows: dict[tuple[bytes, bytes], bool] = {}
        self.halves: dict[bytes, list[bytes]] = {}
        self.edges: dict[bytes, tuple[bytes, ...]] = {}
        self.clear()

    def clear(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.alive: list[tuple[tuple[bytes, bytes], ...]] = []
        #: By 256 times the state plus the byte: 256 times the next state, and the token that ends here.
        self.arcs: dict[int, tuple[int, int]] = {}
        #: The state that a beginning of a piece leads to, and the token that ends at each byte.
        self.heads: dict[bytes, tuple[int, list[int]]] = {}
        self.start = self.state(((b"", b""),))

    def state(self, alive: tuple[tuple[bytes, bytes], ...]) -> int:
        """256 times the state of these alive borders: the bytes behind each and the token before it."""
        if alive not in self.ids:
            self.ids[alive] = len(self.alive) << 8
            self.alive.append(alive)
        return self.ids[alive]

    def half(self, token: bytes) -> list[bytes]:
        """The tokens that a longer one is merged from: two, unless the ranks do not rise from parts to wholes."""
        if (known := self.halves.get(token)) is None:
            known = self.halves[token] = self.merged(token, self.ranks[token])
        return known

    def edge(self, token: bytes) -> tuple[bytes, ...]:
        """A token, the right one of the two it was merged from, and so on."""
        if (known := self.edges.get(token)) is None:
            right = () if len(token) < 2 else self.edge(self.half(token)[-1])
            known = self.edges[token] = (token, *right)
        return known

    def stand_in(self, token: bytes, read: bytes) -> bytes:
        """The shortest end of a token that acts like it before ``read`` and whatever follows."""
        ranks, acts = self.ranks, token
        for part in self.edge(token):
            reach = part + read
            if reach in self.starts:
                return acts
            for n in range(len(part) + 1, len(reach) + 1):
                if reach[:n] in ranks:
                    return acts
            acts = part
        return b""

    def may_follow(self, left: bytes, right: bytes) -> bool:
        """Whether merging the bytes of both gives just these two tokens."""
        if (known := self.follows.get((left, right))) is None:
            if len(self.follows) >= FOLLOWS:
                self.follows.clear()
            known = self.follows[left, right] = self.apart(left, right)
        return known

    def apart(self, left: bytes, right: bytes) -> bool:
        """Whether no merge crosses the border of two tokens.

        Their merges are undone from the last one to the first; none across the
        border may come before the one undone last.  Of equal ones the left comes first.
        """
        ranks, limit, both = self.ranks, self.worst, [left, right]
        while True:
            if ranks.get(left + right, limit) < limit:
                return False
            if len(left) > 1 and (len(right) < 2 or ranks[left] > ranks[right]):
                limit, parts = ranks[left], self.half(left)
                left = parts[-1]
            elif len(right) > 1:
                limit, parts = ranks[right] + 1, self.half(right)
                right = parts[0]
            else:
                return True
            if len(parts) != 2:
                return self.merged(b"".join(both)) == both

    def merged(self, piece: bytes, below: int | None = None) -> list[bytes]:
        """The tokens of a short run of bytes by merging its best pair again and again, or with ranks below one."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        worst = self.worst if below is None else below
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], worst), i) for i in range(len(parts) - 1))
            if rank >= worst:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def arc(self, at: int) -> tuple[int, int]:
        """The arc of a state and byte, made now."""
        byte, token, alive, starts, ranks = bytes([at & 255]), None, [], self.starts, self.ranks
        for read, before in self.alive[at >> 8]:
            read += byte
            if token is None and read in ranks and (not before or self.may_follow(before, read)):
                token = read
            if read in starts:
                alive.append((read, before and self.stand_in(before, read)))
        if token is None:
            raise ValueError(f"no token ends at {byte} after {self.alive[at >> 8]}")
        alive.append((b"", self.stand_in(token, b"")))
        made = self.arcs[at] = self.state(tuple(alive)), ranks[token]
        return made

    def back(self, ends: list[int], at: int) -> list[int]:
        """The borders on the way back from one, itself first."""
        out = [at]
        while at:
            at -= self.length[ends[at - 1]]
            out.append(at)
        return out

    def encode(self, piece: bytes) -> list[int]:
        """The ids of a piece, emitted as soon as no byte to come can change them."""
        if len(self.arcs) > self.most or len(self.heads) > HEADS:
            self.clear()
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        head = piece[:HEAD]
        if (known := self.heads.get(head)) is None:
            ends: list[int] = []
            known = self.heads[head] = self.walk(self.start, head, ends), ends
        state, ends = known[0], known[1][:]
        if len(piece) <= self.ahead:
            self.walk(state, piece[HEAD:], ends)
            return self.tokens(ends, len(ends))
        out = []
        for begin in range(HEAD, len(piece), self.ahead):
            state = self.walk(state, piece[begin:begin + self.ahead], ends)
            if begin + self.ahead < len(piece):
                ways = [set(self.back(ends, len(ends) - len(read))) for read, _ in self.alive[state >> 8]]
                settled = max(set.intersection(*ways))
                out += self.tokens(ends, settled)
                del ends[:settled]
        return out + self.tokens(ends, len(ends))

    def walk(self, state: int, run: bytes, ends: list[int]) -> int:
        """The state that a run of bytes leads to; appends the token that ends at each."""
        arcs = self.arcs
        for byte in run:
            try:
                state, token = arcs[state + byte]
            except KeyError:  # an arc is made once and read many times
                state, token = self.arc(state + byte)
            ends.append(token)
        return state

    def tokens(self, ends: list[int], at: int) -> list[int]:
        """The tokens up to a border, by the token that ends at each."""
        out, length = [], self.length
        while at:
            out.append(token := ends[at - 1])
            at -= length[token]
        return out[::-1]


class Utf8Stream:
    """Text of bytes that come in pieces: a state machine over the bytes of a character.

    A state says how many continuation bytes are due and the range of the next
    one.  What can't belong to a character becomes U+FFFD, one for each run that
    could have begun one.
    """

    def __init__(self) -> None:
        self.due, self.low, self.high, self.code = 0, 0x80, 0xBF, 0

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.due:
                if self.low <= b <= self.high:
                    self.code = self.code << 6 | b & 0x3F
                    self.due, self.low, self.high = self.due - 1, 0x80, 0xBF
                    if not self.due:
                        out.append(chr(self.code))
                    continue
                out.append("�")
                self.due, self.low, self.high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.due, self.code = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.due, self.code = 2, b & 0x0F
                self.low, self.high = 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
            elif 0xF0 <= b <= 0xF4:
                self.due, self.code = 3, b & 0x07
                self.low, self.high = 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
            else:
                out.append("�")
        return "".join(out)

    def state(self) -> tuple[int, int, int, int]:
        return self.due, self.low, self.high, self.code

    def close(self) -> str:
        rest, self.due = "�" if self.due else "", 0
        return rest


def moved(state: tuple, data: bytes) -> tuple[str, tuple]:
    """The text that bytes complete after a state, and the state then."""
    stream = Utf8Stream()
    stream.due, stream.low, stream.high, stream.code = state
    return stream.feed(data), stream.state()


def unsplit(ranks: dict[bytes, int]) -> dict[int, str]:
    """The texts of tokens that end no character halfway."""
    made = {rank: moved(Decoder.EMPTY, token) for token, rank in ranks.items()}
    return {rank: text for rank, (text, state) in made.items() if not state[0]}


class Decoder:
    """Ids to text, one id at a time; what an id does in a state is worked out once."""

    EMPTY = Utf8Stream().state()

    def __init__(self, ranks: dict[bytes, int], whole: dict[int, str] | None = None):
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.moves: dict[tuple, dict[int, tuple[str, tuple]]] = {}
        self.made = 0
        self.whole = unsplit(ranks) if whole is None else whole

    def move(self, state: tuple, token: int) -> tuple[str, tuple]:
        made = moved(state, self.tokens[token])
        self.made += 1
        if self.made > MOVES:
            self.moves.clear()
            self.made = 1
        self.moves.setdefault(state, {})[token] = made
        return made

    def pieces(self, ids):
        """The text that each id completes, then what is left over."""
        state = self.EMPTY
        known = self.moves.setdefault(state, {})
        for token in ids:
            text, after = known.get(token) or self.move(state, token)
            if after != state:
                state = after if after[0] else self.EMPTY
                known = self.moves.setdefault(state, {})
            yield text
        if state[0]:
            yield "\ufffd"

    def decode(self, ids) -> str:
        """The text of all ids; the machine runs from an id that splits a character to the end of that character."""
        out, at = list(map(self.whole.get, ids)), 0
        while True:
            try:
                at = out.index(None, at)
            except ValueError:  # all ids have their text
                return "".join(out)
            state = self.EMPTY
            while True:
                known = self.moves.setdefault(state, {})
                out[at], state = known.get(ids[at]) or self.move(state, ids[at])
                at += 1
                if not state[0]:
                    break
                if at == len(ids):
                    return "".join(out) + "\ufffd"


class Encoder:
    """Texts to ids by a pattern that cuts pieces and a transducer that encodes each.

    A chunk between single spaces that neither begins nor ends with white space
    is cut alike wherever it stands, so its ids are remembered: the chunks met
    lately in one table, those met before that in another that the first replaces
    when it is full.  Other texts are cut as a whole.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = CHUNK_BYTES, starts: set[bytes] | None = None,
                 decimals: dict[int, str] | None = None):
        self.transducer, self.pattern, self.most = Transducer(ranks, starts=starts), regex.compile(pattern), most
        self.decimals = decimals or {rank: str(rank) for rank in ranks.values()}
        self.size = 0
        self.chunks: dict[str, tuple[str, tuple[int, ...]]] = {}
        self.before: dict[str, tuple[str, tuple[int, ...]]] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def cut(self, text: str) -> list[int]:
        encode = self.transducer.encode
        return list(chain.from_iterable([encode(piece.encode()) for piece in self.pattern.findall(text)]))

    def learn(self, chunks: set[str]) -> bool:
        """Remembers (ids as decimals, ids) of chunks after a space; False if the context of any matters."""
        self.size += CHUNK_COST * len(chunks) + 6 * sum(map(len, chunks))  # its text, and its ids twice
        new = []
        for chunk in chunks:
            if (known := self.before.get(chunk)) is not None:
                self.chunks[chunk] = known
            elif not chunk or chunk.strip() != chunk:
                return False
            else:
                new.append(chunk)
        if not new:
            return True
        encode, pieces, decimals, made = self.transducer.encode, self.pieces, self.decimals, []
        had = len(pieces)
        for piece in self.pattern.findall(" " + " ".join(new)):
            if (ids := pieces.get(piece)) is None:
                ids = pieces[piece] = tuple(encode(piece.encode()))
            if piece[0] == " ":  # no chunk has one inside
                made.append(ids)
            else:
                made[-1] += ids
        self.size += PIECE_COST * (len(pieces) - had)
        for chunk, ids in zip(new, made, strict=True):
            self.chunks[chunk] = (" ".join([decimals[i] for i in ids]), ids)
        return True

    def encode(self, text: str) -> tuple[list[int], str]:
        """The ids, and these as decimals joined by spaces."""
        if self.size > self.most:
            self.chunks, self.before, self.pieces, self.size = {}, self.chunks, {}, 0
        first, *rest = text.split(" ")
        new = set(rest).difference(self.chunks)
        if rest and (not first or first[-1].isspace()) or new and not self.learn(new):
            ids = self.cut(text)
            return ids, " ".join(map(str, ids))
        found = list(map(self.chunks.__getitem__, rest))
        ids = self.cut(first)
        head = [" ".join(map(str, ids))] if ids else []
        ids.extend(chain.from_iterable([x[1] for x in found]))
        return ids, " ".join(head + [x[0] for x in found])


@lru_cache(maxsize=1)
def known(path: str) -> tuple[dict[bytes, int], set[bytes], dict[int, str], dict[int, str]]:
    """What a worker process keeps between tasks: the rank file, its tokens' beginnings and texts, ranks as decimals; none grows."""
    ranks = load_ranks(path)
    return ranks, beginnings(ranks), unsplit(ranks), {rank: str(rank) for rank in ranks.values()}


def codec(path: str, pattern: str) -> tuple[Encoder, Decoder]:
    """One of each for a task, whose tables go with it."""
    ranks, starts, whole, decimals = known(path)
    return Encoder(ranks, pattern, starts=starts, decimals=decimals), Decoder(ranks, whole)


def encode_texts(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                 with_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of every row's text (null: empty).

    The ids are those of greedy merging by rank of each match of ``pattern``
    separately; they are decoded again as a stream.  The digests are of the ids
    as decimals joined by one space, and of the decoded text's bytes.  An empty
    text has no ids, and the digests of nothing.  Repeated rows give repeated
    rows; other columns are left out.  ``with_ids`` adds the ids and the decoded text.  The rank
    file must lie at ``path`` on every executor.
    """
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
              T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]

    def make():
        encoder, decoder = codec(path, pattern)

        def row(text):
            ids, decimals = encoder.encode(text or "")
            decoded = decoder.decode(ids)
            out = (len(ids), hashlib.sha256(decimals.encode()).hexdigest(),
                   hashlib.sha256(decoded.encode()).hexdigest())
            return (*out, ids, decoded) if with_ids else out
        return row

    return map_rows(df, make, [text_col], [id_col], fields)
