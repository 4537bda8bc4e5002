"""Language identification by compression.

For each language seen in training a raw-content dictionary for zstandard is made of pieces of sampled texts. A text is
compressed block by block with each dictionary; the language with the fewest bytes wins. score is the winner's margin
over the next, as a part of the next one's size. A margin below min_margin is narrow, and the text is rejected.

Defined results: a null text, or one without a letter, is `und` with score 0, rejected. So is each text if no language
was learned. With one language learned there's no rival, and the score is 1. Ties go to the language with more training
rows, then to the first by name, with score 0, rejected. Texts of any length are compressed whole. Repeated rows give
repeated results; other columns of the input aren't read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, texts

#: Bounds of the training sample, whatever the size of the corpus: texts of a language, characters of a text, bytes of a
#: language's dictionary and of all dictionaries. Every language is learned; where they are very many, each gets less.
SAMPLE_TEXTS, PIECE_CHARS, DICTIONARY_BYTES, ALL_BYTES = 400, 160, 65_536, 64 << 20
BLOCK_BYTES, LEVEL = 4096, 6
MIN_MARGIN = 0.005

UNDETERMINED = "und"
_LETTERS = bytes(c if chr(c).isalpha() or c > 127 else 0x20 for c in range(256))


@dataclass(frozen=True)
class Model:
    """Languages with more training rows first, and the dictionary of each."""

    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]


def letters(text: bytes) -> bytes:
    """Lower case, and one space for all between words of letters. UTF-8 in and out."""
    return b" ".join(text.decode("utf-8").lower().encode("utf-8").translate(_LETTERS).split())


def fit(df: DataFrame, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from rows with a label and a text. A first pass counts rows by label; the second takes, by a hash of the id,
    about SAMPLE_TEXTS rows of each label and a piece of each at a place that the hash gives. Only that bounded sample comes
    to the driver."""
    rows = df.select(F.col(label_col).alias("label"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("label is not null and text is not null")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").collect()}
    if not counts:
        return Model((), ())
    each = min(DICTIONARY_BYTES, ALL_BYTES // len(counts))
    n_texts = max(1, SAMPLE_TEXTS * each // DICTIONARY_BYTES)
    shares = df.sparkSession.createDataFrame([(label, min(1.0, 1.5 * n_texts / n + 8 / n)) for label, n in counts.items()], "label string, share double")
    chance = F.pmod(F.xxhash64(F.lit(1), F.col("id"), F.when(F.col("id").isNull(), F.col("text"))), F.lit(1 << 30)) / float(1 << 30)
    place = F.pmod(F.xxhash64(F.lit(2), F.col("id"), F.col("text")), F.greatest(F.length("text") - PIECE_CHARS, F.lit(0)) + 1) + 1
    sample = rows.join(F.broadcast(shares), "label").where(chance < F.col("share")).select("label", chance.alias("chance"), F.substr("text", place.cast("int"), F.lit(PIECE_CHARS)).alias("piece"))
    pieces: dict[str, list] = defaultdict(list)
    for r in sample.limit(4 * (n_texts + 8) * len(counts)).collect():
        pieces[r["label"]].append((r["chance"], r["piece"]))
    learned = [label for label in counts if pieces[label]]
    return Model(tuple(learned), tuple(b" ".join(letters(piece.encode("utf-8")) for _, piece in sorted(pieces[label])[:n_texts])[:each] for label in learned))


class Classifier:
    def __init__(self, model: Model):
        import zstandard

        self.model = model
        self.compressors = []
        for content in model.dictionaries:
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=False, write_content_size=False, write_dict_id=False))

    def predict(self, text: bytes | None) -> tuple[str, float]:
        core = letters(text or b"")
        if not core or not self.compressors or not (any(chr(c).isalpha() for c in core if c < 128) or any(map(str.isalpha, text.decode("utf-8")))):
            return UNDETERMINED, 0.0
        blocks = [core[at : at + BLOCK_BYTES] for at in range(0, len(core), BLOCK_BYTES)]
        sizes = [sum(len(compressor.compress(block)) for block in blocks) for compressor in self.compressors]
        if len(sizes) == 1:
            return self.model.languages[0], 1.0
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rival = min(size for i, size in enumerate(sizes) if i != best)
        return self.model.languages[best], (rival - sizes[best]) / rival


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", min_margin: float = MIN_MARGIN, keep: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """Returns id_col, the columns of keep (of df, as they are), lang_pred, score and rejected; these three begin with prefix,
    if columns of df have their names."""
    kept = [id_col, *keep]
    names = [f"{prefix}{name}" for name in ("lang_pred", "score", "rejected")]
    schema = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in kept), *map(T.StructField, names, (T.StringType(), T.DoubleType(), T.BooleanType()))])
    place = kept.index(text_col) if text_col in kept else len(kept)
    shipped = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(shipped.value)
        for batch in slices(batches):
            rows = [classifier.predict(text) for text in texts(batch.column(place))]
            scores = [score for _, score in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array([x for x, _ in rows], pa.string()), pa.array(scores, pa.float64()), pa.array([s < min_margin for s in scores], pa.bool_())], [*kept, *names])

    return df.select(*(F.col(f"`{c}`") for c in kept), *(() if place < len(kept) else (F.col(f"`{text_col}`").alias("__text"),))).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is held out of training: by the crc32 of the id as text."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
