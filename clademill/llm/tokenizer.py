"""Byte-pair encoding by a lazily determinised transducer over the merges of a public rank file."""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator

import numpy as np

# Fixed value: the pattern that splits a text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: States that a machine keeps, and its moves and decisions; beyond that it starts anew.
MAX_STATES = 200_000
MAX_MOVES = 1_000_000
#: Bytes after which what is certain of a long piece is emitted.
BLOCK = 4096
NEVER = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Transducer:
    """Encodes bytes left to right, token by token, as the merges would.

    The encoding of a prefix is that of a shorter prefix and one more token, and of all tokens that end a prefix
    exactly one goes with the encoding before it (their two byte strings, merged together, give the two tokens
    back). So for each prefix only its last token is found, and a register keeps it with what it forbids to follow.
    Tokens may begin anywhere; the sets of tokens that are unfinished at a time are the states of the determinised machine. Such
    a set is named by the bytes of its longest member, of which all others are suffixes. A move gives the next state and the
    tokens that may end there; the registers of the places where these begin decide between them. States, moves and decisions are made
    when a text first needs them. States hold no token that has ended, so texts of random letters share them too.

    What the encodings of all prefixes that a token may still go on from have in common is certain and is emitted, ``BLOCK``
    bytes and the unfinished tokens after it was read.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.sizes = token_lengths(ranks).tolist()
        self.many = len(self.sizes)
        self.least: dict[bytes, int] = {}  # of the tokens that go on from these bytes the smallest rank
        for t, i in ranks.items():
            for n in range(1, len(t)):
                if i < self.least.get(t[:n], NEVER):
                    self.least[t[:n]] = i
        self.split: dict[int, tuple[int, int] | None] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.shapes: list[tuple[tuple[bytes, int], ...]] = [()]
        self.shape_number = {(): 0}
        self.shape_of: dict[int, int] = {}
        self.forget()

    def forget(self) -> None:
        """Drops all states but the first, moves and decisions."""
        self.keys, self.number, self.moves, self.pairs = [b""], {b"": 0}, {}, {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte and for what merges never make."""
        if token not in self.split:
            text = self.token[token]
            parts = [text[i : i + 1] for i in range(len(text))]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], NEVER))
                if parts[best] + parts[best + 1] not in self.ranks:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            self.split[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.split[token]

    def edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The parts that touch the left (0) or right (1) end of ``token`` while it is merged, each with the merge that ends it."""
        known = self.edges[side].get(token)
        if known is None:
            known, part, until = [], token, NEVER
            while True:
                known.append((self.token[part], until))
                both = self.halves(part)
                if both is None:
                    break
                part, until = both[side], part
            self.edges[side][token] = known
        return known

    def shape(self, parts: tuple[tuple[bytes, int], ...]) -> int:
        """The number of a set of parts that may merge with what follows."""
        number = self.shape_number.get(parts)
        if number is None:
            number = self.shape_number[parts] = len(self.shapes)
            self.shapes.append(parts)
        return number

    def ending(self, token: int) -> int:
        """The shape of the parts at the right end of ``token`` that some merge continues before they are used up."""
        number = self.shape_of.get(token)
        if number is None:
            number = self.shape_of[token] = self.shape(tuple((t, until) for t, until in self.edge(token, 1) if self.least.get(t, NEVER) < until))
        return number

    def follows(self, shape: int, token: int) -> bool:
        """True if ``token`` can stand after a token of this ``shape``.

        It can't if a part at the right end of the one and a part at the left end of the other merge with each
        other before either is used up; of equal merges the left one is done first.
        """
        get, right_parts = self.ranks.get, self.edge(token, 0)
        for left, left_until in self.shapes[shape]:
            for right, right_until in right_parts:
                made = get(left + right)
                if made is not None and made < left_until and made <= right_until:
                    return False
        return True

    def move(self, state: int, byte: int) -> tuple[int, int, int, tuple[tuple[int, int, int], ...]]:
        """The state after one more byte; id and shape of the token that ends there if no longer one can; those, longest first, each after its length."""
        window = self.keys[state] + bytes((byte,))
        n, longer = len(window), []
        for j in range(n - 1):
            other = self.ranks.get(window[j:])
            if other is not None and self.halves(other) is not None:
                longer.append((n - j, other, self.ending(other)))
        token = self.ranks[window[-1:]]
        open_ = next((window[j:] for j in range(n) if window[j:] in self.least), b"")
        number = self.number.get(open_)
        if number is None:
            number = self.number[open_] = len(self.keys)
            self.keys.append(open_)
        return number, token, self.ending(token), tuple(longer)

    def certain(self, state: int, ended: list[int]) -> int:
        """How many bytes all encodings share that may still come of this state; ``ended`` has the last token of each prefix."""
        window, n = self.keys[state], len(ended) - 1
        places = {n} | {n - len(window) + j for j in range(len(window)) if window[j:] in self.least}
        while len(places) > 1:
            most = max(places)
            places.remove(most)
            places.add(most - self.sizes[ended[most]])
        return places.pop()

    def read(self, text: bytes, states: list[int], ended: list[int], shapes: list[int]) -> None:
        """Adds for each byte the state after it, and the token that ends there with its shape."""
        get_move, get_pair, many = self.moves.get, self.pairs.get, self.many
        state = states[-1]
        for byte in text:
            at = state << 8 | byte
            step = get_move(at)
            if step is None:
                step = self.moves[at] = self.move(state, byte)
            state, token, shape, longer = step
            for size, other, its in longer:
                before = shapes[-size]
                follows = not before or get_pair(before * many + other)
                if follows is None:
                    follows = self.pairs[before * many + other] = self.follows(before, other)
                if follows:
                    token, shape = other, its
                    break
            states.append(state)
            ended.append(token)
            shapes.append(shape)

    def ids(self, ended: list[int], upto: int) -> list[int]:
        """The tokens of the first ``upto`` bytes."""
        out, sizes = [], self.sizes
        while upto:
            token = ended[upto]
            out.append(token)
            upto -= sizes[token]
        out.reverse()
        return out

    def full(self) -> bool:
        """True, and everything forgotten, if too much is kept."""
        over = len(self.keys) > MAX_STATES or len(self.moves) + len(self.pairs) > MAX_MOVES
        if over:
            self.forget()
        return over

    def encode(self, text: bytes) -> list[int]:
        """The ids of one piece of text, in time linear in its length."""
        self.full()
        out: list[int] = []
        states, ended, shapes = [0], [-1], [0]
        for begin in range(0, len(text), BLOCK):
            self.read(text[begin : begin + BLOCK], states, ended, shapes)
            upto = len(ended) - 1 if begin + BLOCK >= len(text) else self.certain(states[-1], ended)
            out += self.ids(ended, upto)
            del states[:upto], ended[:upto], shapes[:upto]
        return out

    def encode_sorted(self, texts: list[bytes]) -> tuple[list[int], list[int]]:
        """How many ids each of the sorted pieces has, and the ids; what a piece shares with the one before is read once.

        All pieces take this way, those above ``BLOCK`` bytes block by block.
        """
        count, out = [], []
        states, ended, shapes = [0], [-1], [0]
        for text, same in zip(texts, shared_bytes(texts).tolist()):
            if self.full():
                same = 0
            del states[same + 1 :], ended[same + 1 :], shapes[same + 1 :]
            if len(text) > BLOCK:
                found = self.encode(text)
            else:
                self.read(text[same:], states, ended, shapes)
                found = self.ids(ended, len(text))
            count.append(len(found))
            out += found
        return count, out


def shared_bytes(texts: list[bytes], most: int = 16) -> np.ndarray:
    """The bytes that each text has in common with the one before it, up to ``most``; 0 beside one above ``BLOCK``."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
    begin = np.cumsum(size) - size
    out = np.zeros(len(texts), np.int64)
    at = np.flatnonzero((size[:-1] <= BLOCK) & (size[1:] <= BLOCK)) + 1
    for k in range(most):
        at = at[(size[at] > k) & (size[at - 1] > k)]
        at = at[data[begin[at] + k] == data[begin[at - 1] + k]]
        out[at] = k + 1
    return out


class Decoder:
    """Ids to text: token bytes are gathered for many rows at once; an incremental UTF-8 machine keeps unfinished characters between calls."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.lengths = token_lengths(ranks)
        order = sorted(ranks.items(), key=lambda x: x[1])
        self.table = np.frombuffer(b"".join(t for t, _ in order), np.uint8)
        self.begin = np.cumsum(self.lengths) - self.lengths

    def raw(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids, one after the other, and where each begins, with the end of the last."""
        n = self.lengths[ids]
        upto = np.concatenate([[0], np.cumsum(n)])
        return self.table[np.repeat(self.begin[ids] - upto[:-1], n) + np.arange(upto[-1])], upto

    def stream(self, pieces: Iterable[Iterable[int]]) -> Iterator[str]:
        """The text of consecutive lists of ids, as far as it is certain after each; broken UTF-8 becomes U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in pieces:
            yield machine.decode(self.raw(np.asarray(list(ids), np.int64))[0].tobytes())
        yield machine.decode(b"", True)


def token_lengths(ranks: dict[bytes, int]) -> np.ndarray:
    """Bytes of each token, by id."""
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    return lengths
