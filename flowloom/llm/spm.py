"""SentencePiece encoding and decoding with a streaming Viterbi lattice.

The lattice has a state for each position of the normalised text: its best last piece and where that
began. For a unigram model the best is the highest sum of scores. For a BPE model it is the one
piece that merging would leave there: a piece may follow another if merging the two strings
alone would never join them across their border, and exactly one piece of every position may
follow the state before it, so the lattice gives what merging gives.

Only states within one maximum piece length of the end can be continued. Whenever the
back pointers of all of those meet at one boundary, the ids up to it are committed and their
states dropped, so a text of any length is encoded in a window of bounded size.

Where no piece holds a space mark after another character, all paths meet before every run of
marks, and at line feeds that no piece holds: there the window is empty, so what follows, up to the next such
place, gives the same ids wherever it stands. The ids that the window committed for such a span are remembered in a
bounded table; new spans pass the window in sorted order and keep the states of the beginning they share.

Edge cases: null and empty texts have no ids; characters outside the vocabulary become byte
pieces, or the unknown id without those; the mark U+2581 in a text is read as a space (as the
format has it), everything else decodes to the text it came from; repeated rows get equal
results; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowloom.llm.words import slices, texts_of

#: A public model (see its README).
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Fixed values of the model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
#: Spans that are remembered, and the longest of them.
REMEMBERED, REMEMBERED_LENGTH = 150_000, 64
#: Bytes of text whose new spans are sorted together.
TOGETHER = 1 << 20


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of each field of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if byte < 0x80:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        elif tag & 7 == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if tag & 7 == 5 else 8
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Vocabulary:
    """The pieces of a model file, and what of its settings matters here."""

    def __init__(self, model: bytes) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.dummy_prefix, charsmap, squeeze = UNIGRAM, True, b"", True
        for number, value in _fields(model):
            if number == 1:
                one = dict(_fields(value))
                self.pieces.append((one[1].decode("utf-8"), struct.unpack("<f", one.get(2, b"\0\0\0\0"))[0], one.get(3, NORMAL)))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                own = dict(_fields(value))
                charsmap, self.dummy_prefix, squeeze = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1))
        if charsmap or squeeze:
            raise ValueError("models that rewrite characters or spaces need their texts normalised first")
        if any(kind in (USER_DEFINED, UNUSED) for _, _, kind in self.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        self.scores = [s for _, s, _ in self.pieces]
        self.unknown = next((i for i, x in enumerate(self.pieces) if x[2] == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.longest = max(map(len, self.ids), default=1)
        self.alphabet = {c for p in self.ids for c in p}
        if self.kind == BPE and not all(c in self.ids for c in self.alphabet):
            raise ValueError("a BPE model needs a piece for each of its characters")
        self.inner_marks = any(MARK in p.lstrip(MARK) for p in self.ids)
        plain = {CONTROL: b"", UNKNOWN: " ⁇ ".encode()}
        self.surface = [bytes([int(p[3:5], 16)]) if kind == BYTE else plain[kind] if kind in plain else p.replace(MARK, " ").encode() for p, _, kind in self.pieces]

    def spell(self, char: str) -> list[int]:
        """Ids of a character that no piece holds."""
        return [self.bytes[b] for b in char.encode("utf-8")] if len(self.bytes) == 256 else [self.unknown]

    def written(self, text: str, path: Iterable[tuple[int, int]]) -> list[int]:
        """Ids of a path of (begin, id)."""
        out: list[int] = []
        for begin, i in path:
            if i >= 0:
                out.append(i)
            else:
                out += self.spell(text[begin])
        return out


class Lattice:
    """Which piece is best at a position, given the states before it.

    The id of a state is -1 for a character that no piece holds and -2 at the start.
    """

    def __init__(self, vocabulary: Vocabulary, remembered: int | None = None) -> None:
        self.vocabulary, self.remembered = vocabulary, REMEMBERED if remembered is None else remembered
        self.window = vocabulary.longest
        self._history: dict[int, tuple | None] = {}
        self._may_follow: dict[int, bool] = {}
        self._lowest = min((vocabulary.scores[i] for i in vocabulary.ids.values()), default=0.0) - UNKNOWN_PENALTY
        #: Each end of a piece, with the id if it is one.
        self.ends: dict[str, int] = {}
        for piece, i in vocabulary.ids.items():
            for n in range(1, len(piece)):
                self.ends.setdefault(piece[n:], -1)
            self.ends[piece] = i

    def advance(self, text: str, last: list[int], size: list[int], score: list[float]) -> None:
        """Add the states that are missing up to the end of ``text``: id and length of the best last piece at each position, and its score."""
        ends, known, many, bpe, scores = self.ends, self._may_follow, len(self.vocabulary.scores), self.vocabulary.kind == BPE, self.vocabulary.scores
        for end in range(len(last), len(text) + 1):
            best, at, high = -1, end - 1, 0.0 if bpe else score[end - 1] + self._lowest
            found = False
            for begin in range(end - 1, max(-1, end - 1 - self.window), -1):
                i = ends.get(text[begin:end])
                if i is None:
                    break
                if i < 0:
                    continue
                before = last[begin]
                if bpe:
                    follows = known.get(before * many + i) if before >= 0 else None
                    if follows is None:
                        follows = self.may_follow(before, i)
                    if follows:
                        best, at = i, begin
                        break
                elif (new := score[begin] + scores[i]) >= high or not found and begin == end - 1:
                    best, at, high, found = i, begin, new, True
            last.append(best)
            size.append(end - at)
            score.append(high)

    def history(self, i: int) -> tuple | None:
        """The ranks at which merging builds a piece, and its outer symbols before each: None if it builds something else."""
        if i not in self._history:
            ids, scores, piece = self.vocabulary.ids, self.vocabulary.scores, self.vocabulary.pieces[i][0]
            symbols, ranks, left, right = list(piece), [], [piece[0]], [piece[-1]]
            while len(symbols) > 1:
                best = max(((scores[ids[a + b]], -n) for n, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in ids), default=None)
                if best is None:
                    break
                n = -best[1]
                symbols[n : n + 2] = [symbols[n] + symbols[n + 1]]
                ranks.append(-best[0])
                left.append(symbols[0])
                right.append(symbols[-1])
            self._history[i] = (ranks, left, right) if len(symbols) == 1 else None
        return self._history[i]

    def may_follow(self, before: int, i: int) -> bool:
        """Whether merging the two pieces' strings leaves the two: no step joins symbols across their border."""
        if before < 0:
            return self.history(i) is not None
        key = before * len(self.vocabulary.pieces) + i
        known = self._may_follow.get(key)
        if known is None:
            if len(self._may_follow) > 2 * self.remembered:
                self._may_follow.clear()
            known = self._may_follow[key] = self._stays_apart(before, i)
        return known

    def _stays_apart(self, before: int, piece: int) -> bool:
        one, two = self.history(before), self.history(piece)
        if one is None or two is None:
            return False
        ids, scores = self.vocabulary.ids, self.vocabulary.scores
        (ranks1, _, right), (ranks2, left, _) = one, two
        i = j = 0
        while True:
            a = ranks1[i] if i < len(ranks1) else None
            b = ranks2[j] if j < len(ranks2) else None
            joined = ids.get(right[i] + left[j])
            if joined is not None:
                c = -scores[joined]
                if (a is None or c < a) and (b is None or c <= b):
                    return False
            if a is None and b is None:
                return True
            if b is None or a is not None and a <= b:
                i += 1
            else:
                j += 1


class Window:
    """The text that is not committed yet, with the state at each of its positions."""

    def __init__(self, lattice: Lattice) -> None:
        self.lattice, self.most_states, self.commits = lattice, 1, 0
        self._clear()

    def _clear(self) -> None:
        self.text, self.last, self.size, self.score, self.dropped = "", [-2], [0], [0.0], False

    def rewind(self, text: str) -> str:
        """Begin ``text`` anew with the states of the beginning that it shares with the window; returns the rest of it.

        States depend on what is before them alone.
        """
        if self.dropped:
            self._clear()
        same = 0
        for a, b in zip(text, self.text):
            if a != b:
                break
            same += 1
        self.text = text[:same]
        del self.last[same + 1 :], self.size[same + 1 :], self.score[same + 1 :]
        return text[same:]

    def push(self, part: str) -> list[int]:
        """Take more text; returns the ids that became certain."""
        step = self.lattice.window
        if len(self.text) + len(part) < 3 * step:  # too short for a commit
            self.text += part
            self.lattice.advance(self.text, self.last, self.size, self.score)
            return []
        out: list[int] = []
        for i in range(0, len(part), step):
            self.text += part[i : i + step]
            self.lattice.advance(self.text, self.last, self.size, self.score)
            self.most_states = max(self.most_states, len(self.last))
            if len(self.last) > 3 * step:
                out += self._commit(self._meeting())
        return out

    def close(self) -> list[int]:
        """The ids of the rest, which stays until the next text begins."""
        return self._ids(len(self.text))

    def _meeting(self) -> int:
        """The last boundary on the paths of all states that can still be continued."""
        end = len(self.text)
        alive = set(range(max(0, end - self.lattice.window + 1), end + 1))
        while len(alive) > 1:
            last = max(alive)
            alive.discard(last)
            alive.add(last - self.size[last])
        return alive.pop()

    def _ids(self, boundary: int) -> list[int]:
        path, at, last, size = [], boundary, self.last, self.size
        self.commits += boundary > 0
        while at > 0:
            n = size[at]
            path.append((at - n, last[at]))
            at -= n
        path.reverse()
        return self.lattice.vocabulary.written(self.text, path)

    def _commit(self, boundary: int) -> list[int]:
        ids = self._ids(boundary)
        if boundary:
            self.text, self.dropped = self.text[boundary:], True
            del self.last[:boundary], self.size[:boundary], self.score[:boundary]
        return ids


class Stream:
    """Encodes a normalised text that arrives in parts, and hands out ids as soon as they are certain.

    Spans are taken from the table of remembered ones or pass the window; a span that is longer than those
    stays in the window, whose size is bounded.
    """

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.tokenizer, self.window, self.open, self.end = tokenizer, Window(tokenizer.lattice), "", ""

    def feed(self, part: str) -> list[int]:
        """Take more text; returns the ids that became certain."""
        spans, out = self.tokenizer.spans, []
        if spans is None:
            return self.window.push(part)
        if self.end:  # a long span goes on up to the next mark after another character, or line feed
            there = re.compile(f"(?<!{MARK}){MARK}|\n").search(self.end + part, 1)
            n = there.start() - 1 if there else len(part)
            out += self.window.push(part[:n])
            self.end, part = (part[:n] or self.end)[-1], part[n:]
            if not there:
                return out
            out += self.window.close()
            self.end = ""
            self.window.rewind("")
        *whole, self.open = spans.findall(self.open + part) or [""]
        out += self.tokenizer.ids_of(whole)
        if len(self.open) > REMEMBERED_LENGTH:
            out += self.window.push(self.window.rewind(self.open))
            self.open, self.end = "", self.open[-1]
        return out

    def finish(self) -> list[int]:
        """The ids of the rest."""
        rest, self.open = self.open, ""
        return self.tokenizer.ids_of([rest]) if rest else self.window.close()


class Tokenizer:
    """Encodes and decodes whole texts."""

    def __init__(self, model: bytes, remembered: int | None = None) -> None:
        self.vocabulary, self.remembered = Vocabulary(model), REMEMBERED if remembered is None else remembered
        self.lattice = Lattice(self.vocabulary, remembered)
        #: Passes of new spans.
        self.window = Window(self.lattice)
        #: Ids of spans as bytes, at most twice ``remembered`` and what a call needs: the older half goes when the newer is full.
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        line = "" if "\n" in self.vocabulary.alphabet else "\n"
        self.spans = None if self.vocabulary.inner_marks else re.compile(f"{MARK}*[^{MARK}{line}]+|{MARK}+" + ("|\n" if line else ""))

    def stream(self, text: str) -> list[int]:
        """Ids of normalised text that passes a window of its own."""
        window = Window(self.lattice)
        ids = window.push(text)
        return self._one_unknown(np.array(ids + window.close(), np.int32)).tolist()

    def _one_unknown(self, ids: np.ndarray) -> np.ndarray:
        """Without byte pieces, a run of unknown characters has one id."""
        if len(self.vocabulary.bytes) == 256 or len(ids) < 2:
            return ids
        unknown = ids == self.vocabulary.unknown
        return ids[~(unknown & np.append(False, unknown[:-1]))]

    def normalise(self, text: str) -> str:
        return (MARK if self.vocabulary.dummy_prefix and text else "") + text.replace(" ", MARK)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def ids_of(self, spans: list[str]) -> list[int]:
        """Ids of spans in order."""
        return np.frombuffer(b"".join(map(self._learn(spans).__getitem__, spans)), np.int32).tolist()

    def _learn(self, spans: Iterable[str]) -> dict[str, bytes]:
        """The table of remembered spans, with all of these: new ones pass the window in sorted order."""
        if len(self._known) > self.remembered:
            self._known, self._older = {}, self._known
        known, older, window, once = self._known, self._older, self.window, {}
        for span in sorted(set(spans).difference(known)):
            found = older.get(span)
            if found is None:
                sure = window.push(window.rewind(span))
                found = array("i", sure + window.close() if sure else window.close()).tobytes()
            (known if len(span) <= REMEMBERED_LENGTH else once)[span] = found
        return known | once if once else known

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        whole = [self.normalise(t) for t in texts]
        if self.spans is None:
            return [np.array(self.stream(t), np.int32) for t in whole]
        spans = list(map(self.spans.findall, whole))
        known = self._learn(set().union(*spans))
        return [self._one_unknown(np.frombuffer(b"".join(map(known.__getitem__, c)), np.int32)) for c in spans]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.vocabulary.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.vocabulary.dummy_prefix and text[:1] == " " else text


@lru_cache(maxsize=2)
def tokenizer_of(model: bytes, remembered: int = REMEMBERED) -> Tokenizer:
    """The tokenizer of a model, once for each process."""
    return Tokenizer(model, remembered)


def read_model(path: str = MODEL) -> bytes:
    """The model file, a local file of the driver."""
    with open(path, "rb") as file:
        return file.read()


def encode(documents: DataFrame, model: bytes, remembered: int = REMEMBERED, together: int = TOGETHER) -> DataFrame:
    """doc_id, ids (array<int>) and n_tokens of all documents (doc_id, text).

    More ``remembered`` spans and more bytes of text worked on ``together`` cost memory and save time; ids are the same.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(shared.value, remembered)
        for part in slices(batches, "text", together):
            ids = tokenizer.encode_all([t.decode("utf-8") for t in texts_of(part, "text")])
            sizes = np.array([len(x) for x in ids], np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(sizes)], ["doc_id", "ids", "n_tokens"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens int")


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """doc_id, ids, n_tokens and text, the decoded ids, of the rows of :func:`encode`."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(shared.value)
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                part = whole.slice(first, 500)
                lists = part.column(1)
                ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
                ids = lists.flatten().to_numpy(zero_copy_only=False).tolist()
                texts = [tokenizer.decode(ids[a:b]) for a, b in zip([0, *ends], ends)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "n_tokens", "text"])

    return encoded.select("doc_id", "ids", "n_tokens").mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens int, text string")
