"""Token counts of fields or sections from one encoding of the whole document.

A document is encoded once with a byte-level BPE vocabulary; the lengths of its tokens give
byte spans, and those give spans of code points. Token spans are joined to the spans of
sections by binary search on both ends.

A token that crosses a boundary is allocated by ``rule``: ``first`` gives it to the section that
holds its first code point, ``last`` to that of its last, ``split`` shares it by code points. Under
each the counts of sections that tile a text add up to the tokens of the text.

Edge cases: null and empty texts have one empty section; sections may overlap or leave gaps
(each is counted by itself); repeated rows get equal results; other columns are ignored; an
empty table gives an empty result. Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowloom.llm.words import slices, texts_of

#: A public vocabulary (see its README) and the pattern that cuts a text before merging.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("first", "last", "split")


class Encoder:
    """Byte-level BPE with the lengths of its tokens."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), np.int64)

    def spans(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last code point of each token."""
        end = np.cumsum(self.lengths[ids])
        begin = end - self.lengths[ids]
        char = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80) - 1
        return (char[begin], char[end - 1]) if len(ids) else (begin, end)


@lru_cache(maxsize=2)
def encoder_of(vocabulary: bytes) -> Encoder:
    """The encoder of a vocabulary, once for each process."""
    return Encoder(vocabulary)


def attribute(first: np.ndarray, last: np.ndarray, begin: np.ndarray, end: np.ndarray, rule: str) -> np.ndarray:
    """Tokens (first and last code points, in order) allocated to each section [begin, end)."""
    if rule in ("first", "last"):
        at = first if rule == "first" else last
        return (np.searchsorted(at, end) - np.searchsorted(at, begin)).astype(np.float64)
    if rule != "split":
        raise ValueError(f"rule has to be one of {RULES}, not {rule!r}")
    size = last - first + 1
    order = np.searchsorted  # tokens that share a code point overlap, so each side is counted by itself

    def before(x: np.ndarray) -> np.ndarray:
        """Tokens before code point x, in fractions."""
        if not len(first):
            return np.zeros(len(x))
        whole = order(last, x)  # these end before x
        begun = order(first, x)  # these begin before x
        share = np.concatenate([[0.0], np.cumsum(1.0 / size)])
        where = np.concatenate([[0.0], np.cumsum(first / size)])
        return whole + x * (share[begun] - share[whole]) - (where[begun] - where[whole])

    return before(end) - before(begin)


def line_sections(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the lines of a text in code points, each with its line feed."""
    raw = np.frombuffer(text, np.uint8)
    start = (raw & 0xC0) != 0x80
    total = int(start.sum())
    cuts = np.cumsum(start)[raw == 10]
    end = np.append(cuts, total) if not len(cuts) or cuts[-1] < total else cuts
    return np.append(0, end[:-1]), end


RESULT = "section int, begin_char long, end_char long, n_tokens long, shared_tokens double"


def count_tokens(documents: DataFrame, vocabulary: str = VOCABULARY, rule: str = "first", sections=line_sections) -> DataFrame:
    """Tokens of the sections of all documents (doc_id, text).

    Returns doc_id, section (0, 1, ...), begin_char, end_char, n_tokens (under ``rule``, first or
    last) and shared_tokens (under split). ``sections`` gives the spans of a text.
    """
    if rule not in ("first", "last"):
        raise ValueError("n_tokens counts whole tokens: rule has to be first or last")
    with open(vocabulary, "rb") as file:  # a local file of the driver; executors get its bytes
        shared = documents.sparkSession.sparkContext.broadcast(file.read())
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        for part in slices(batches, "text"):
            rows, columns = [], []
            for i, text in enumerate(texts_of(part, "text")):
                begin, end = sections(text)
                first, last = encoder.spans(text, encoder.encode(text.decode("utf-8")))
                rows.append(np.full(len(begin), i))
                columns.append((np.arange(len(begin)), begin, end, attribute(first, last, begin, end, rule), attribute(first, last, begin, end, "split")))
            nth, begin, end, whole, shares = (np.concatenate(c) for c in zip(*columns, strict=True))
            ids = part.column(0).take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(nth.astype(np.int32)), pa.array(begin.astype(np.int64)), pa.array(end.astype(np.int64)), pa.array(whole.astype(np.int64)), pa.array(shares)],
                ["doc_id", "section", "begin_char", "end_char", "n_tokens", "shared_tokens"],
            )

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {RESULT}")
