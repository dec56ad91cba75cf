"""Byte-level BPE as a lazily determinised transducer, and decoding by an incremental UTF-8 machine.

A sequence of tokens is the encoding of its bytes exactly if every two neighbours
are the encoding of theirs: merges of different neighbourhoods do not see each other,
and those of one neighbourhood come in the same order alone and in the whole.  So every prefix of a
word has one encoding, and the transducer only needs, for each place inside the word where a token may have
begun, the token before it and the node of the vocabulary's trie reached since.  These pairs are
the nondeterministic states.  A deterministic state is a set of them, each with the tokens it is ahead of what has
been emitted.  Reading a byte extends all pairs, adds the one that ends a token
here, and emits the tokens that all of them share: what a state holds back is the
lookahead, bounded by the vocabulary.  States and their 256 edges are made when first
needed, and thrown away together when they become too many.  Words go through it side by side: each step of numpy
reads the next byte of many words, and only edges that are not there yet are made one by one.

Decoding feeds each token's bytes to a UTF-8 machine that keeps at most three bytes of an
unfinished character.

Defined cases: a null text is empty and has no ids; bytes that are no UTF-8 are read as U+FFFD, also in decoding, as
Python does; null ids decode to nothing; unknown ids raise; repeated rows are encoded like any other; an empty table
gives none; texts and words of any length are read byte by byte, without recursion.
"""

from __future__ import annotations

import base64
import re
import sys
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from insightspark.llm.common import Batches, map_arrow, pieces, record_batch

# Deterministic states kept before their table starts anew, and words before those not met lately go.
STATES = 800_000
WORDS = 1_000_000
# Longer words are not kept.
_WORD = 40
# Longer words are read alone, and this many bytes of the others side by side.
_LONG = 64
_BLOCK = 1 << 17
_BATCH = 8 << 20


class Ranks(NamedTuple):
    """The path of a rank file and the pattern whose matches are encoded separately."""

    file: str
    pattern: str


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_steps(data: bytes, ranks: dict[bytes, int]) -> tuple[list[bytes], list[tuple[int, bytes, bytes]]]:
    """The tokens that merging the lowest-ranked pair again and again leaves, and each step's rank with the
    first and last token after it; for short strings."""
    parts = [data[i : i + 1] for i in range(len(data))]
    steps = [(-1, parts[0], parts[-1])]
    none = len(ranks) + 256
    while len(parts) > 1:
        best, at = min((ranks.get(a + b, none), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best == none:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        steps.append((best, parts[0], parts[-1]))
    return parts, steps


class _Edge(NamedTuple):
    """A token's outermost pieces on one side as merges go on: (piece, rank it is made at, rank it ends at)."""

    pieces: list[tuple[bytes, int, int]]
    # Whether the ranks of the token's merges ascend, so that ranks tell times.
    ascending: bool


class _Edges:
    """The transducer's edges in arrays: by state * 256 + byte the next state and what is emitted, an index of ids."""

    def __init__(self) -> None:
        self._keys = np.full(1 << 12, -1, dtype=np.int64)
        self._at = np.zeros(len(self._keys), dtype=np.int32)
        # With room for more, so that adding does not copy what is there each time.
        self._count = 0
        self.targets = np.zeros(1 << 12, dtype=np.int32)
        self.emits = np.zeros(1 << 12, dtype=np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or the free one where its search ends."""
        # Fibonacci hashing: the upper bits of the product.
        shift = np.uint64(65 - len(self._keys).bit_length())
        slots = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int64)
        found = self._keys[slots]
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & (len(self._keys) - 1)
            found = self._keys[slots[open_]]
            open_ = open_[(found != keys[open_]) & (found >= 0)]
        return slots

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key's edge, -1 where there is none."""
        slots = self._slots(keys)
        return np.where(self._keys[slots] >= 0, self._at[slots], -1)

    def add(self, keys: np.ndarray, targets: list[int], emits: list[int]) -> None:
        """New edges of different keys."""
        begin, self._count = self._count, self._count + len(keys)
        if self._count > len(self.targets):
            room = np.zeros(2 * self._count - begin, dtype=np.int32)
            self.targets, self.emits = np.concatenate([self.targets[:begin], room]), np.concatenate([self.emits[:begin], room])
        self.targets[begin : self._count] = targets
        self.emits[begin : self._count] = emits
        numbers = np.arange(begin, self._count, dtype=np.int32)
        if 2 * self._count > len(self._keys):
            full = self._keys >= 0
            keys, numbers = np.concatenate([self._keys[full], keys]), np.concatenate([self._at[full], numbers])
            self._keys = np.full(1 << int(4 * len(keys)).bit_length(), -1, dtype=np.int64)
            self._at = np.zeros(len(self._keys), dtype=np.int32)
        while len(keys):
            slots = self._slots(keys)
            # Of keys that end at one free place the last stays; the others search on.
            self._keys[slots] = keys
            stays = self._keys[slots] == keys
            self._at[slots[stays]] = numbers[stays]
            keys, numbers = keys[~stays], numbers[~stays]


def _different(numbers: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers, all below ``limit``, and the place of each number among them."""
    occurs = np.zeros(limit, dtype=bool)
    occurs[numbers] = True
    return np.flatnonzero(occurs), (np.cumsum(occurs, dtype=np.int32) - 1)[numbers]


class Transducer:
    """Ids of words, byte by byte.

    A state is a flat tuple: the last id emitted (-1: none, or no way needs it), then for each way through the word the ids it is ahead
    and the trie node since; the last way has just ended a token.
    """

    def __init__(self, ranks: dict[bytes, int], limit: int = STATES):
        self.ranks, self.limit = ranks, limit
        self._bytes = {rank: token for token, rank in ranks.items()}
        self._never = max(ranks.values()) + 1
        # The trie: edges by node * 256 + byte, and the id that ends at a node.
        self._edges: dict[int, int] = {}
        self._ends: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                node = self._edges.get(key) or self._edges.setdefault(key, len(self._ends))
                if node == len(self._ends):
                    self._ends.append(-1)
            self._ends[node] = rank
        # Nodes that a longer token goes through; at the others a way has no next byte.
        self._inner = bytearray(len(self._ends))
        for key in self._edges:
            self._inner[key >> 8] = 1
        self._sides: dict[int, tuple[_Edge, _Edge] | None] = {}
        self.restart()

    def restart(self) -> None:
        """Forget all deterministic states; they are made again when needed."""
        self._numbers: dict[tuple, int] = {}
        self._states: list[tuple] = []
        self._steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        self._side_by_side = _Edges()
        # Sequences of ids that edges emit, and their numbers.
        self._emits: list[tuple[int, ...]] = []
        self._sequences: dict[tuple[int, ...], int] = {}
        self._sequence(())
        self._pairs: dict[int, bool] = {}
        self._number((-1, (), 0))

    def _number(self, state: tuple) -> int:
        found = self._numbers.get(state)
        if found is None:
            found = self._numbers[state] = len(self._states)
            self._states.append(state)
        return found

    def _sides_of(self, token: int) -> tuple[_Edge, _Edge] | None:
        """The pieces at a token's left and right end; None if merges never make the token."""
        if token in self._sides:
            return self._sides[token]
        own = self._bytes[token]
        parts, steps = merge_steps(own, self.ranks)
        found = None
        if parts == [own]:
            ascending = all(x[0] <= y[0] for x, y in zip(steps, steps[1:]))
            sides = []
            for side in (1, 2):
                made = [x for i, x in enumerate(steps) if not i or x[side] != steps[i - 1][side]]
                ends = [x[0] for x in made[1:]] + [self._never]
                sides.append(_Edge([(x[side], x[0], end) for x, end in zip(made, ends)], ascending))
            found = (sides[0], sides[1])
        self._sides[token] = found
        return found

    def _follows(self, before: int, token: int) -> bool:
        """Whether ``token`` may stand after ``before`` (-1: first): no merge ever crosses their border.

        A merge crosses where two pieces lie at the border at the time of their rank.
        """
        after = self._sides_of(token)
        if after is None or before < 0:
            return after is not None
        (_, left), (right, _) = self._sides_of(before), after
        certain = left.ascending and right.ascending
        if certain:
            # Back from the last pieces, over the pairs that lie at the border together.
            ranks, i, j = self.ranks, len(left.pieces) - 1, len(right.pieces) - 1
            while i >= 0 and j >= 0:
                a, a_made, a_end = left.pieces[i]
                b, b_made, b_end = right.pieces[j]
                rank = ranks.get(a + b)
                # Of equal ranks the leftmost merges first.
                if rank is not None and rank < a_end and rank <= b_end:
                    if rank > a_made and rank > b_made:
                        return False
                    certain = False
                if a_made > b_made:
                    i -= 1
                else:
                    j -= 1
        # Where a pair's rank is below those of its own pieces, ranks tell no times.
        expected = [self._bytes[before], self._bytes[token]]
        return certain or merge_steps(b"".join(expected), self.ranks)[0] == expected

    def _step(self, number: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Make the edge of a state for a byte: the next state and the ids that are certain now."""
        state, ways, ended = self._states[number], [], None
        emitted, edges, ends, inner, pairs = state[0], self._edges, self._ends, self._inner, self._pairs
        for i in range(1, len(state), 2):
            node = edges.get(state[i + 1] << 8 | byte)
            if node:
                ahead = state[i]
                if inner[node]:
                    ways += (ahead, node)
                token = ends[node]
                if ended is None and token >= 0:
                    before = ahead[-1] if ahead else emitted
                    pair = before << 32 | token
                    follows = pairs.get(pair)
                    if follows is None:
                        follows = pairs[pair] = self._follows(before, token)
                    if follows:
                        ended = (*ahead, token)
        # Every byte is a token, so a way always ends here: the encoding of what was read.
        assert ended is not None, "every byte must be a token"
        ways += (ended, 0)
        certain = ways[0]
        if certain:
            for i in range(2, len(ways), 2):
                while certain and ways[i][: len(certain)] != certain:
                    certain = certain[:-1]
        if certain:
            emitted = certain[-1]
            for i in range(0, len(ways), 2):
                ways[i] = ways[i][len(certain) :]
        # What was emitted matters to ways that are not ahead of it.
        before = -1 if all(ways[::2]) else emitted
        return self._number((before, *ways)), certain

    def encode(self, word: bytes) -> list[int]:
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        ids: list[int] = []
        state, steps = 0, self._steps
        for byte in word:
            found = steps.get(state << 8 | byte)
            if found is None:
                if len(self._states) >= self.limit:
                    # Forget all states but the present one.
                    present = self._states[state]
                    self.restart()
                    state, steps = self._number(present), self._steps
                found = steps[state << 8 | byte] = self._step(state, byte)
            state, certain = found
            ids += certain
        # At the end of the word the way that just ended a token is its encoding.
        ids += self._states[state][-2]
        return ids

    def encode_all(self, words: Sequence[bytes]) -> list[bytes]:
        """The ids of each word as the bytes of 32-bit integers."""
        whole = list(map(self.ranks.get, words))
        out = [b"" if x is None else x.to_bytes(4, sys.byteorder) for x in whole]
        order = sorted((i for i, x in enumerate(whole) if x is None), key=lambda i: -len(words[i]))
        long = sum(len(words[i]) > _LONG for i in order)
        alone, block, size = order[:long], [], 0
        for i in (*order[long:], -1):
            if block and (i < 0 or size + len(words[i]) > _BLOCK):
                if len(self._states) + size > self.limit:
                    self.restart()
                if len(self._states) + size > self.limit:
                    alone += block
                else:
                    for j, ids in zip(block, self._read([words[j] for j in block])):
                        out[j] = ids
                block, size = [], 0
            if i >= 0:
                block.append(i)
                size += len(words[i])
        for i in alone:
            out[i] = np.array(self.encode(words[i]), dtype=np.int32).tobytes()
        return out

    def _sequence(self, ids: tuple[int, ...]) -> int:
        number = self._sequences.setdefault(ids, len(self._emits))
        if number == len(self._emits):
            self._emits.append(ids)
        return number

    def _read(self, words: list[bytes]) -> list[bytes]:
        """The ids of words in falling order of their lengths, a byte of each at a time."""
        edges, lengths = self._side_by_side, np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        text = np.frombuffer(b"".join(words), dtype=np.uint8)
        starts = np.cumsum(lengths) - lengths
        states = np.zeros(len(words), dtype=np.int64)
        # A place for what each byte emits, and one for the end of its word.
        places = starts + np.arange(len(words))
        emitted = np.zeros(len(text) + len(words), dtype=np.int32)
        for at in range(int(lengths[0])):
            alive = int(np.searchsorted(-lengths, -at, side="left"))
            keys = states[:alive] << 8 | text[starts[:alive] + at]
            found = edges.find(keys)
            if found.min() < 0:
                missing = np.unique(keys[found < 0])
                made = [self._step(key >> 8, key & 255) for key in missing.tolist()]
                edges.add(missing, [state for state, _ in made], [self._sequence(ids) for _, ids in made])
                found = edges.find(keys)
            emitted[places[:alive] + at] = edges.emits[found]
            states[:alive] = edges.targets[found]
        last, of = _different(states, len(self._states))
        ends = np.array([self._sequence(self._states[state][-2]) for state in last.tolist()], dtype=np.int32)
        emitted[places + lengths] = ends[of]
        # The sequences that occur, then the ids of all places in order.
        some, of = _different(emitted, len(self._emits))
        ids = [self._emits[number] for number in some.tolist()]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        begin = np.cumsum(sizes) - sizes
        counts = sizes[of]
        after = np.cumsum(counts)
        source = np.repeat(begin[of] - (after - counts), counts) + np.arange(int(after[-1]))
        flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(sizes.sum()))[source].tobytes()
        bounds = [0, *(4 * after[places + lengths]).tolist()]
        return [flat[a:b] for a, b in zip(bounds, bounds[1:])]


class Encoder:
    """Ids of whole texts: the pattern's matches through the transducer.

    A match never goes on from a visible character to a blank, so texts are cut before such blanks, and the ids of
    short cuts are remembered.
    """

    # A blank after a visible character; and what tells that other blanks occur.
    _CUT = re.compile(r"(?<=\S) ")
    _OTHER = re.compile(r"\s ")

    def __init__(self, ranks: Ranks, states: int = STATES, words: int = WORDS):
        import regex

        self.ranks = read_ranks(ranks.file)
        self.transducer = Transducer(self.ranks, states)
        self._parts = regex.compile(ranks.pattern)
        # Ids of cuts without their blank: those met lately, and those met before them.
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._words = words

    def _matches(self, text: str) -> list[str]:
        return [x[0] for x in self._parts.finditer(text)]

    def _learn(self, firsts: list[str], words: list[str]) -> list[bytes]:
        """The ids of the texts' first cuts; those of the words after a blank become known."""
        # Words that end visibly can be matched in one go: each begins at a blank after a visible character.
        plain, others = [], []
        for word in words:
            (plain if word and " " not in word and not word[-1].isspace() else others).append(word)
        parts = self._matches(" " + " ".join(plain)) if plain else []
        begins = [i for i, part in enumerate(parts) if part[0] == " "]
        for cut in chain(firsts, [" " + x for x in others]):
            begins.append(len(parts))
            parts += self._matches(cut)
        begins.append(len(parts))
        different = list(dict.fromkeys(parts))
        ids = dict(zip(different, self.transducer.encode_all([x.encode("utf-8", "replace") for x in different])))
        each = [ids[x] for x in parts]
        cuts = [b"".join(each[a:b]) for a, b in zip(begins, begins[1:])]
        known = self._known
        known.update(zip(plain, cuts))
        known.update(zip(others, cuts[len(plain) + len(firsts) :]))
        return cuts[len(plain) : len(plain) + len(firsts)]

    def encode_all(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text as the bytes of 32-bit integers."""
        # Arrow cuts and counts; texts with other blanks are cut here, with an empty one in their place.
        odd = {i: self._CUT.split(x) for i, x in enumerate(texts) if self._OTHER.search(x)}
        try:
            plain = pa.array(["" if i in odd else x for i, x in enumerate(texts)], pa.large_string())
        except UnicodeEncodeError:  # lone surrogates
            odd = {i: odd.get(i) or x.split(" ") for i, x in enumerate(texts)}
            plain = pa.array([""] * len(texts), pa.large_string())
        split = pc.split_pattern(plain, " ")
        coded = split.flatten().dictionary_encode()
        # One string of all words, which hold no blank, is much faster to hand over than each.
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), pa.scalar(" ", pa.large_string()))
        words = joined[0].as_py().split(" ") if len(coded.dictionary) else []
        index, bounds = coded.indices.to_numpy().astype(np.int64), split.offsets.to_numpy().astype(np.int64)
        firsts = [words[i] for i in index[bounds[:-1]].tolist()]
        if odd:
            numbers = {word: i for i, word in enumerate(words)}
            more = []
            for i, cuts in odd.items():
                firsts[i] = cuts[0]
                more.append([numbers.setdefault(x, len(numbers)) for x in cuts[1:]])
            words = list(numbers)
            index = np.concatenate([index, np.fromiter(chain.from_iterable(more), dtype=np.int64)])
            bounds = np.concatenate([bounds, bounds[-1] + np.cumsum([len(x) for x in more])])
        # The table: first cuts of all texts, then the words that occur after a blank.
        at = bounds[: len(texts)]
        index += len(texts)
        index[at] = np.arange(len(texts))
        entries, index = _different(index, len(texts) + len(words))
        used = [words[i] for i in (entries[len(texts) :] - len(texts)).tolist()]
        table = self._firsts_and_words(firsts, used)
        lengths = np.fromiter(map(len, table), dtype=np.int64, count=len(table)) // 4
        starts = np.cumsum(lengths) - lengths
        each = lengths[index]
        upto = np.concatenate([[0], np.cumsum(each)])
        source = np.repeat(starts[index] - upto[:-1], each)
        source += np.arange(len(source))
        flat = np.frombuffer(b"".join(table), dtype=np.int32)[source].tobytes()
        ends = (4 * upto[bounds]).tolist()
        out = [flat[a:b] for a, b in zip(ends, ends[1:])]
        for i, rest in zip(odd, out[len(texts) :]):
            out[i] += rest
        return out[: len(texts)]

    def _firsts_and_words(self, firsts: list[str], words: list[str]) -> list[bytes]:
        """The ids of first cuts, and those of different words after a blank."""
        if 2 * len(self._known) >= self._words:
            self._known, self._older = {}, self._known
        known, older, new = self._known, self._older, []
        out = list(map(known.get, words))
        unknown = [i for i, ids in enumerate(out) if ids is None]
        for i in unknown:
            word = words[i]
            own = older.get(word)
            if own is None:
                new.append(word)
            else:
                known[word] = own
        first = self._learn(firsts, new)
        for i in unknown:
            out[i] = known[words[i]]
        for word in new:
            if len(word) >= _WORD:
                del known[word]
        return first + out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], dtype=np.int32).tolist()


# The UTF-8 machine.  States: 0 between characters, else what continuation bytes may follow.
_START, _ONE, _TWO, _THREE, _TWO_E0, _TWO_ED, _THREE_F0, _THREE_F4 = range(8)


def _utf8_edges() -> list[list[int]]:
    """The next state for a state and a byte; -1 where the byte cannot follow."""
    edges = [[-1] * 256 for _ in range(8)]

    def put(state: int, low: int, high: int, target: int) -> None:
        for byte in range(low, high + 1):
            edges[state][byte] = target

    put(_START, 0x00, 0x7F, _START)
    put(_START, 0xC2, 0xDF, _ONE)
    put(_START, 0xE1, 0xEF, _TWO)
    put(_START, 0xE0, 0xE0, _TWO_E0)
    put(_START, 0xED, 0xED, _TWO_ED)
    put(_START, 0xF1, 0xF3, _THREE)
    put(_START, 0xF0, 0xF0, _THREE_F0)
    put(_START, 0xF4, 0xF4, _THREE_F4)
    put(_ONE, 0x80, 0xBF, _START)
    put(_TWO, 0x80, 0xBF, _ONE)
    put(_TWO_E0, 0xA0, 0xBF, _ONE)
    put(_TWO_ED, 0x80, 0x9F, _ONE)
    put(_THREE, 0x80, 0xBF, _TWO)
    put(_THREE_F0, 0x90, 0xBF, _TWO)
    put(_THREE_F4, 0x80, 0x8F, _TWO)
    return edges


_UTF8 = _utf8_edges()
_REPLACEMENT = "�"


class Utf8Stream:
    """Text from bytes that come in pieces cut anywhere.

    Characters come out when their last byte is in.  Bytes that cannot go on become one U+FFFD for the part of a
    character that could, and one for each byte that begins none.
    """

    def __init__(self) -> None:
        self.state, self.held = _START, b""

    def feed(self, data: bytes) -> str:
        out: list[str] = []
        for byte in data:
            target = _UTF8[self.state][byte]
            if target < 0 and self.state != _START:
                out.append(_REPLACEMENT)
                self.held = b""
                target = _UTF8[_START][byte]
            if target < 0:
                out.append(_REPLACEMENT)
                self.state = _START
                continue
            self.held += bytes((byte,))
            self.state = target
            if target == _START:
                out.append(self.held.decode("utf-8"))
                self.held = b""
        return "".join(out)

    def end(self) -> str:
        """What an unfinished character leaves."""
        rest = _REPLACEMENT if self.held else ""
        self.state, self.held = _START, b""
        return rest


class Decoder:
    """Text from ids as they come; the machine's steps over a token are made once per held bytes and token."""

    def __init__(self, ranks: dict[bytes, int]):
        self._bytes = {rank: token for token, rank in ranks.items()}
        self._steps: dict[bytes, dict[int, tuple[str, bytes]]] = {b"": {}}
        # The texts of tokens that begin and end between characters.
        steps = {token: self._step(b"", token) for token in self._bytes}
        self._whole = {token: text for token, (text, held) in steps.items() if not held and _REPLACEMENT not in text}
        self._table = pa.array([self._whole.get(i) for i in range(max(self._bytes) + 1)], type=pa.large_string())

    def _step(self, held: bytes, token: int) -> tuple[str, bytes]:
        machine = Utf8Stream()
        machine.feed(held)
        text = machine.feed(self._bytes[token])
        # Held bytes are the beginning of one character, so there are few of them.
        self._steps.setdefault(machine.held, {})
        found = self._steps[held][token] = (text, machine.held)
        return found

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Pieces of text, one per id at most."""
        held = b""
        steps = self._steps[held]
        for token in ids:
            step = steps.get(token) or self._step(held, token)
            text, after = step
            if after is not held:
                held, steps = after, self._steps[after]
            if text:
                yield text
        if held:
            yield _REPLACEMENT

    def decode(self, ids: Sequence[int]) -> str:
        texts = list(map(self._whole.get, ids))
        return "".join(self.stream(ids) if None in texts else texts)

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The text of each run of ids between two offsets.

        The machine's steps over tokens that begin and end between characters only put their texts one after another; it goes
        alone from every other token to the next place between characters.
        """
        tokens = self._table.take(pa.array(ids))
        ends = np.frombuffer(tokens.buffers()[1], dtype=np.int64, count=len(ids) + 1)
        odd = np.flatnonzero(tokens.is_null().to_numpy(zero_copy_only=False))
        data = memoryview(tokens.buffers()[2] or b"")
        texts = []
        for at, end in zip(offsets.tolist(), offsets.tolist()[1:]):
            parts = []
            for first in odd[np.searchsorted(odd, at) : np.searchsorted(odd, end)].tolist():
                if first < at:
                    continue
                parts.append(str(data[ends[at] : ends[first]], "utf-8"))
                at, held = first, b""
                while at < end and (held or at == first):
                    token = int(ids[at])
                    text, held = self._steps[held].get(token) or self._step(held, token)
                    parts.append(text)
                    at += 1
                if held:
                    parts.append(_REPLACEMENT)
            parts.append(str(data[ends[at] : ends[end]], "utf-8"))
            texts.append("".join(parts))
        return pa.array(texts, type=pa.string())


_CODERS: dict[tuple, tuple[Encoder, Decoder]] = {}


def worker_coders(ranks: Ranks, states: int) -> tuple[Encoder, Decoder]:
    """One encoder and decoder per Python worker, so their states serve later tasks too."""
    key = (ranks, states)
    if key not in _CODERS:
        _CODERS.clear()
        encoder = Encoder(ranks, states)
        _CODERS[key] = (encoder, Decoder(encoder.ranks))
    return _CODERS[key]


def encode_documents(documents: DataFrame, ranks: Ranks, states: int = STATES, decoded: bool = False) -> DataFrame:
    """doc_id, ids (array of INT): the tokens of each whole text, in the rows' order; and, if ``decoded``, the
    text that those ids spell."""

    def run(batches: Batches, schema: pa.Schema) -> Batches:
        encoder, decoder = worker_coders(ranks, states)
        for whole in batches:
            for batch in pieces(whole, _BATCH):
                each = encoder.encode_all([(x or b"").decode("utf-8", "replace") for x in batch.column(1).to_pylist()])
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in each])]).astype(np.int32)
                flat = np.frombuffer(b"".join(each), dtype=np.int32)
                rows = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)).cast(schema.field(1).type)
                yield record_batch(schema, [batch.column(0), rows, *([decoder.decode_all(flat, offsets)] if decoded else [])])

    kind = documents.schema["doc_id"].dataType.simpleString()
    more = ", text string" if decoded else ""
    return map_arrow(documents.select("doc_id", F.col("text").cast("binary")), f"doc_id {kind}, ids array<int>{more}", run)


def decode_documents(encoded: DataFrame, ranks: Ranks) -> DataFrame:
    """The rows of ``encoded`` (doc_id, ids) with ``text``: what their ids spell."""

    def run(batches: Batches, schema: pa.Schema) -> Batches:
        decoder = Decoder(read_ranks(ranks.file))
        for whole in batches:
            for batch in pieces(whole, _BATCH):
                texts = [decoder.decode(x or ()) for x in batch.column(1).to_pylist()]
                yield record_batch(schema, [batch.column(0), batch.column(1), texts])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return map_arrow(encoded.select("doc_id", "ids"), f"doc_id {kind}, ids array<int>, text string", run)
