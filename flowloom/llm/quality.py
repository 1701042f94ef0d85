"""Quality rules: a linear-chain conditional random field over lines.

Base rules come first: too few words, or too many words in repeated 5-word windows. Of the
other documents every line is labelled content or boilerplate by Viterbi decoding of a
linear-chain CRF over surface features, and a document is kept if lines of content hold at
least ``KEEP_SHARE`` of its words.

The CRF is trained on a bounded sample of labelled documents (``MODEL_DOCS`` of each class, in
the order of a hash of their ids, of each ``MODEL_LINES`` lines of its first ``MODEL_CHARS`` characters; the model has a few dozen
weights, so more rows would not change it). Lines of good documents are content; of bad
documents, the lines that show a surface sign are boilerplate (all, if none shows one). All
documents are then scored whole.

Edge cases: a null or empty text has no words and fails the base rules; without labelled
documents of both classes every line is content; repeated rows get equal results; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowloom.llm.words import Words, slices, texts_of

SYMBOLS = b"#*$%&|<>"
#: Of the base rules.
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 10, 20, 5
#: Share of the words that has to be in lines of content.
KEEP_SHARE = 0.5
#: Bounds of the sample that the CRF is trained on.
MODEL_DOCS, MODEL_LINES, MODEL_CHARS = 600, 48, 20_000
STEPS, RATE, RIDGE = 120, 0.2, 0.02

#: Features of a line. From SIGNS on each is a sign of boilerplate.
FEATURES = (
    "always", "one to four words", "over forty words", "ends a sentence",
    "some symbols", "many symbols", "mostly capitals", "shouting", "bars", "digits", "word repeats", "few different words", "seen above", "link or code",
)
SIGNS = 4

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_CODE = np.zeros(256, bool)
_CODE[list(b"{}=;@\\_")] = True


class Lines:
    """Lines with words of some texts: their text, word counts, features and whole-text counts."""

    def __init__(self, texts: list[bytes]) -> None:
        words = Words(texts)
        buffer, n = words.buffer, len(texts)
        self.words, self.n_texts = words, n
        ends = np.flatnonzero(buffer == 10)
        line = np.searchsorted(ends, words.start)
        used, word_line = np.unique(line, return_inverse=True)
        count = np.bincount(word_line, minlength=len(used))
        begin, end = np.concatenate([[-1], ends])[used] + 1, ends[used]
        self.text = np.searchsorted(words.text_at, begin, side="right") - 1
        self.count = count

        def each(table: np.ndarray) -> np.ndarray:
            at = np.searchsorted(end, np.flatnonzero(table[buffer]))
            return np.bincount(at, minlength=len(used) + 1)[: len(used)]

        def only(byte: int) -> np.ndarray:
            table = np.zeros(256, bool)
            table[byte] = True
            return each(table)

        size = np.maximum(1, np.bincount(word_line, weights=words.end - words.start, minlength=len(used)))
        accents = np.flatnonzero((buffer[:-1] == 0xC3) & (buffer[1:] >= 0x80) & (buffer[1:] <= 0x9E))
        upper = each(_UPPER) + np.bincount(np.searchsorted(end, accents), minlength=len(used) + 1)[: len(used)]
        symbols = each(_SYMBOL)
        same = np.zeros(len(used))
        if len(words.hash) > 1:
            again = (words.hash[1:] == words.hash[:-1]) & (word_line[1:] == word_line[:-1])
            same = np.bincount(word_line[1:][again], minlength=len(used))
        order = np.lexsort((words.hash, word_line))
        different = np.zeros(len(used))
        if len(order):
            new = np.concatenate([[True], (words.hash[order][1:] != words.hash[order][:-1]) | (word_line[order][1:] != word_line[order][:-1])])
            different = np.bincount(word_line[order][new], minlength=len(used))
        last_word_end = words.end[np.cumsum(count) - 1] if len(used) else np.zeros(0, int)
        stops = np.isin(buffer[last_word_end - 1], list(b".!?:;\"')")) if len(used) else np.zeros(0, bool)
        self.repeated_line = self._seen(texts, begin, end)
        self.features = np.stack(
            [
                np.ones(len(used)), count <= 4, count > 40, stops,
                symbols > 0.01 * size, symbols > 0.1 * size, (upper > 0.5 * size) & (count > 1), 2 * only(33) >= count, 3 * only(124) >= count,
                each(_DIGIT) > 0.3 * size, (same > 0.2 * count) & (count > 3), (different < 0.4 * count) & (count > 9), self.repeated_line, each(_CODE) > 0.05 * size,
            ],
            axis=1,
        ).astype(np.float64)
        self.n_dup_lines = np.bincount(self.text[self.repeated_line], minlength=n)[:n]
        self.n_symbols = np.bincount(self.text, weights=symbols, minlength=n)[:n].astype(np.int64)
        follow = (buffer & 0xC0) == 0x80
        in_words = np.concatenate([[0], np.cumsum(~follow)])
        self.word_chars = np.bincount(words.text, weights=in_words[words.end] - in_words[words.start], minlength=n)[:n].astype(np.int64)
        self.n_repeat_words = self._repeats()

    def _seen(self, texts: list[bytes], begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which lines equal an earlier line of their text."""
        raw, out, seen, now = self.words.buffer.tobytes(), np.zeros(len(begin), bool), set(), -1
        for i, (text, a, b) in enumerate(zip(self.text.tolist(), begin.tolist(), end.tolist(), strict=True)):
            if text != now:
                seen, now = set(), text
            x = raw[a:b]
            if x in seen:
                out[i] = True
            else:
                seen.add(x)
        return out

    def _repeats(self) -> np.ndarray:
        """Words of each text in windows that its text has twice or more."""
        words = self.words
        first, key = words.windows(WINDOW)
        if len(first) < 2:
            return np.zeros(self.n_texts, np.int64)
        text = words.text[first]
        order = np.lexsort((key, text))
        key, text, first = key[order], text[order], first[order]
        twin = (key[1:] == key[:-1]) & (text[1:] == text[:-1])
        twice = np.concatenate([[False], twin]) | np.concatenate([twin, [False]])
        marks = np.zeros(len(words.hash) + 1, np.int64)
        np.add.at(marks, first[twice], 1)
        np.add.at(marks, first[twice] + WINDOW, -1)
        covered = np.cumsum(marks[:-1]) > 0
        return np.bincount(words.text[covered], minlength=self.n_texts)[: self.n_texts]


class LineField:
    """A linear-chain CRF with labels 0 (content) and 1 (boilerplate)."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray) -> None:
        self.weights, self.steps = weights, steps

    def decode(self, features: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The best labels of all lines, by Viterbi over the lines of each text."""
        scores = features @ self.weights
        (stay0, to1), (to0, stay1) = self.steps.tolist()
        labels = np.zeros(len(text), np.int8)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(text)) + 1, [len(text)]]).tolist() if len(text) else [0]
        rows = scores.tolist()
        for a, b in zip(cuts, cuts[1:]):
            v0, v1 = rows[a]
            from0, from1 = [], []
            for s0, s1 in rows[a + 1 : b]:
                p, q, r, s = v0 + stay0, v1 + to0, v0 + to1, v1 + stay1
                from0.append(q > p)
                from1.append(s >= r)
                v0, v1 = (q if q > p else p) + s0, (s if s >= r else r) + s1
            at = v1 > v0
            labels[b - 1] = at
            for i in range(b - 2, a - 1, -1):
                at = from1[i - a] if at else from0[i - a]
                labels[i] = at
        return labels

    @classmethod
    def content_only(cls) -> LineField:
        """Labels every line content."""
        weights = np.zeros((len(FEATURES), 2))
        weights[0, 0] = 1.0
        return cls(weights, np.zeros((2, 2)))

    @classmethod
    def fit(cls, features: np.ndarray, labels: np.ndarray, text: np.ndarray) -> LineField:
        """Maximise the penalised likelihood of the label sequences by gradient steps."""
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(text)) + 1, [len(text)]])
        sizes = np.diff(cuts)
        n, longest = len(sizes), int(sizes.max())
        grid = np.full((n, longest), len(text))
        for i, (a, size) in enumerate(zip(cuts, sizes)):
            grid[i, :size] = np.arange(a, a + size)
        there = grid < len(text)
        x = np.vstack([features, np.zeros(features.shape[1])])[grid]
        y = np.eye(2)[np.append(labels, 0)[grid]] * there[..., None]
        seen = np.einsum("nlf,nlk->fk", x, y)
        pairs = there[:, 1:, None, None] * y[:, :-1, :, None] * y[:, 1:, None, :]
        seen_steps = pairs.sum((0, 1))
        params = np.zeros(features.shape[1] * 2 + 4)
        m, v = np.zeros_like(params), np.zeros_like(params)
        for step in range(1, STEPS + 1):
            w, t = params[:-4].reshape(-1, 2), params[-4:].reshape(2, 2)
            s = x @ w
            ahead, back = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
            ahead[:, 0] = s[:, 0]
            for i in range(1, longest):
                new = np.logaddexp(ahead[:, i - 1, :1] + t[0], ahead[:, i - 1, 1:] + t[1]) + s[:, i]
                ahead[:, i] = np.where(there[:, i, None], new, ahead[:, i - 1])
            for i in range(longest - 2, -1, -1):
                to = s[:, i + 1] + back[:, i + 1]
                new = np.logaddexp(t[:, 0] + to[:, :1], t[:, 1] + to[:, 1:])
                back[:, i] = np.where(there[:, i + 1, None], new, 0)
            total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])[:, None, None]
            single = np.exp(ahead + back - total) * there[..., None]
            double = np.exp(ahead[:, :-1, :, None] + t + (s + back)[:, 1:, None, :] - total[..., None]) * there[:, 1:, None, None]
            grad = np.concatenate([(seen - np.einsum("nlf,nlk->fk", x, single)).ravel(), (seen_steps - double.sum((0, 1))).ravel()]) / n - RIDGE * params
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            params = params + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return cls(params[:-4].reshape(-1, 2), params[-4:].reshape(2, 2))


def sample_labelled(documents: DataFrame, labels: DataFrame, docs: int = MODEL_DOCS, chars: int = MODEL_CHARS) -> list[tuple[str, int]]:
    """At most ``docs`` labelled texts of each class, in the order of a hash of their ids, and at most ``chars`` characters of each.

    Only the training sample is bounded so, for the driver's memory; whole texts are judged.
    """
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    one = one.where("quality = other").select("doc_id", "quality")
    by_hash = [one.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(docs) for q in (0, 1)]
    picked = F.broadcast(by_hash[0].unionByName(by_hash[1]))
    rows = documents.select("doc_id", "text").join(picked, "doc_id").where("text is not null")
    rows = rows.groupBy("doc_id", "quality").agg(F.min(F.substring("text", 1, chars)).alias("text"))
    return [(r.text, r.quality) for r in sorted(rows.collect(), key=lambda r: (r.quality, r.doc_id))]


def train(documents: DataFrame, labels: DataFrame) -> LineField:
    """A CRF from labelled documents (``labels``: doc_id, quality 0 or 1)."""
    rows = sample_labelled(documents, labels)
    if {q for _, q in rows} != {0, 1}:
        return LineField.content_only()
    lines = Lines([x.encode() for x, _ in rows])
    bad = np.array([q == 0 for _, q in rows])[lines.text]
    sign = lines.features[:, SIGNS:].any(1)
    shows = np.bincount(lines.text[sign], minlength=len(rows)) > 0
    label = (bad & (sign | ~shows[lines.text])).astype(int)
    nth = np.arange(len(lines.text)) - np.searchsorted(lines.text, lines.text)
    used = nth < MODEL_LINES
    return LineField.fit(lines.features[used], label[used], lines.text[used])


def judge(batch_texts: list[bytes], model: LineField, keep_share: float = KEEP_SHARE) -> dict[str, np.ndarray]:
    """Counts and verdict for each text."""
    lines = Lines(batch_texts)
    n = lines.n_texts
    label = model.decode(lines.features, lines.text)
    content = np.bincount(lines.text, weights=lines.count * (label == 0), minlength=n)[:n]
    n_words = lines.words.counts
    failed = (n_words < LEAST_WORDS) | (100 * lines.n_repeat_words > MOST_REPEATED_PERCENT * n_words)
    share = content / np.maximum(1, n_words)
    return {
        "n_words": n_words.astype(np.int64),
        "word_chars": lines.word_chars,
        "n_symbols": lines.n_symbols,
        "n_dup_lines": lines.n_dup_lines.astype(np.int64),
        "n_repeat_words": lines.n_repeat_words.astype(np.int64),
        "base_failed": failed,
        "kept": ~failed & (share >= keep_share),
        "content_share": share,
    }


RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def assess(documents: DataFrame, model: LineField, keep_columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts and verdict of all documents (column text), beside ``keep_columns`` as they are."""
    source = documents.select(*keep_columns, *([] if "text" in keep_columns else ["text"]))
    shared = documents.sparkSession.sparkContext.broadcast((model.weights, model.steps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LineField(*shared.value)
        for part in slices(batches, "text"):
            found = judge(texts_of(part, "text"), own)
            columns = [part.column(part.schema.get_field_index(c)) for c in keep_columns]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, found.values())], [*keep_columns, *found])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep_columns).schema.fields)
    return source.mapInArrow(run, f"{kept}, {RESULT}")


def keep_good(documents: DataFrame, model: LineField) -> DataFrame:
    """The documents (column text; others as they are) whose verdict is kept."""
    shared = documents.sparkSession.sparkContext.broadcast((model.weights, model.steps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LineField(*shared.value)
        for part in slices(batches, "text"):
            yield part.filter(pa.array(judge(texts_of(part, "text"), own)["kept"]))

    return documents.mapInArrow(run, documents.schema)
