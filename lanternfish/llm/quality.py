"""Quality rules as a short-circuit cascade.

Each rule is a test of one text. On a bounded sample the cost (CPU time) and the selectivity (share of rejected rows) of
every rule are measured; then rules run in the order of rejections per cost, and a text leaves at the first rule that
rejects it. The order changes time only: a text is kept if and only if no rule rejects it.

Words are runs between the ASCII white space bytes 0x20 and 0x09 to 0x0D.

Defined results: a null or empty text has no words, all its counts are 0, and base rules reject it. Texts of any length
are read whole. Repeated rows give repeated results; other columns of the input aren't read.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

SYMBOLS = b"#*$%&|<>"
#: Rows of the sample on which rules are measured, whatever the size of the corpus.
SAMPLE_ROWS = 1000
#: A sample that chance makes larger ends at so many times that.
HARD_LIMIT = 4


class View:
    """What rules see of a text: each count is made once, when a rule or the result first asks for it."""

    def __init__(self, raw: bytes | None):
        self.raw = raw or b""

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        continuation = sum(map(len, self.words)) - len(self.raw)  # white space, as a negative number
        return len(self.raw.decode("utf-8")) + continuation

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        """Those with a word."""
        return [line for line in self.raw.split(b"\n") if line.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        words = self.words
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) == len(windows):
            return 0
        counts = Counter(windows)
        marked = bytearray(len(words))
        for at, window in enumerate(windows):
            if counts[window] > 1:
                marked[at : at + 3] = b"\1\1\1"
        return sum(marked)

    @cached_property
    def n_letters(self) -> int:
        return sum(map(str.isalpha, self.raw.decode("utf-8")))


Rule = Callable[[View], bool]

#: True rejects.
BASE_RULES: dict[str, Rule] = {
    "few_words": lambda v: v.n_words < 50,
    "repeated_words": lambda v: 100 * v.n_repeat_words > 50 * v.n_words,
}
RULES: dict[str, Rule] = BASE_RULES | {
    "symbols": lambda v: 10 * v.n_symbols > v.n_words,
    "repeated_lines": lambda v: v.n_dup_lines >= 3 and 100 * v.n_dup_lines > 30 * len(v.lines),
    "word_length": lambda v: not 2 * v.n_words <= v.word_chars <= 15 * v.n_words,
    "few_letters": lambda v: 2 * v.n_letters < v.word_chars,
    "shouting": lambda v: 2 * sum(map(bytes.isupper, v.words)) > v.n_words,
}


def measure(df: DataFrame, rules: dict[str, Rule] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds a row, share of rows rejected) of each rule, on a sample of about sample_rows rows and never more than
    HARD_LIMIT times as many, drawn row by row, however many are copies; the cascade's order comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spent, out = Counter(), Counter()
            for raw in texts(batch.column(0)):
                for name, rule in rules.items():
                    view = View(raw)  # anew: a rule pays for all that it needs
                    began = time.thread_time_ns()
                    out[name] += rule(view)
                    spent[name] += time.thread_time_ns() - began
            names = list(rules)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([spent[n] for n in names], pa.int64()), pa.array([out[n] for n in names], pa.int64()), pa.array([batch.num_rows] * len(names), pa.int64())], ["rule", "ns", "rejected", "rows"])

    total = df.count()
    sample = df.select(text_col) if total <= sample_rows else df.select(text_col).where(F.rand(5) < sample_rows / total).limit(HARD_LIMIT * sample_rows)
    sums = sample.mapInArrow(run, "rule string, ns bigint, rejected bigint, rows bigint").groupBy("rule").sum("ns", "rejected", "rows").collect()
    found = {r[0]: (r[1] / max(1, r[3]) / 1e9, r[2] / max(1, r[3])) for r in sums}
    rows = [(name, *found.get(name, (0.0, 0.0))) for name in rules]
    return sorted(rows, key=lambda x: (-x[2] / max(x[1], 1e-9), list(rules).index(x[0])))


def cascade(df: DataFrame, rules: dict[str, Rule], order: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col, the counts, base_failed and kept (no rule, tried in the order given, rejects the text)."""
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean"
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    base, ordered = list(BASE_RULES.values()), [rules[name] for name in order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns: list[list] = [[] for _ in range(len(counts) + 2)]
            for raw in texts(batch.column(1)):
                view = View(raw)
                rejected = any(rule(view) for rule in ordered)
                row = [*(getattr(view, c) for c in counts), any(rule(view) for rule in base), not rejected]
                for column, value in zip(columns, row):
                    column.append(value)
            types = [pa.int64()] * len(counts) + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, types)], [id_col, *counts, "base_failed", "kept"])

    return df.select(id_col, text_col).mapInArrow(run, schema)
