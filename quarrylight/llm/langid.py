"""Language identification by compression.

For each language a zstandard raw-content dictionary is cut from training texts. A text is folded (lower case, runs of
anything but letters to one space), cut into chunks of ``CHUNK`` bytes that together cover all of it, and each chunk is
compressed with each dictionary; the language whose dictionary gives the smallest total wins. The relative margin to the
second smallest is the score; margins under ``NARROW`` are rejected.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
CHUNK = 2048
LEVEL = 6
#: Least relative margin, (second - first) / first, of a text that is not rejected.
NARROW = 0.01
#: Bounds of the training sample: dictionary bytes a language, characters of a piece of text, pieces a language, languages.
DICT_BYTES = 512 * 1024
PIECE = 800
SAMPLE_PIECES = 1000
LANGUAGES = 256
#: Characters that come to the driver at most.
SAMPLE_CHARS = 40_000_000

_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def folded(text: str) -> bytes:
    return f" {_NOT_LETTERS.sub(' ', text.lower()).strip()} ".encode("utf-8", "replace")


@dataclass
class LanguageModel:
    """Dictionaries by language; pickles as bytes, compressors are made once in each Python worker."""

    dictionaries: dict[str, bytes]
    chunk: int = CHUNK
    level: int = LEVEL
    narrow: float = NARROW
    _coders: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_coders": []}

    def coders(self) -> list[tuple[str, zstandard.ZstdCompressor]]:
        if not self._coders:
            p = zstandard.ZstdCompressionParameters.from_level(self.level, write_content_size=0, write_checksum=0, write_dict_id=0)
            for lang in sorted(self.dictionaries):
                d = zstandard.ZstdCompressionDict(self.dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=p)
                self._coders.append((lang, zstandard.ZstdCompressor(dict_data=d, compression_params=p)))
        return self._coders

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether the margin is too narrow (also for ``und``)."""
        coders = self.coders()
        if not text or not coders or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        data = folded(text)
        parts = [data[k : k + self.chunk] for k in range(0, len(data), self.chunk)]
        sizes = sorted((sum(len(c.compress(p)) for p in parts), lang) for lang, c in coders)
        best = sizes[0][0]
        if len(sizes) == 1:
            return sizes[0][1], 1.0, False
        margin = (sizes[1][0] - best) / best
        tied = [lang for size, lang in sizes if size == best]
        if len(tied) > 1:  # a short text's few bytes of output decide nothing: the dictionary that holds more of its 4-byte strings, by the margin in their number
            held = sorted((-sum(data[k : k + 4] in self.dictionaries[lang] for k in range(len(data) - 3)), lang) for lang in tied)
            margin = (held[1][0] - held[0][0]) / max(1, len(data) - 3)
            return held[0][1], margin, margin < self.narrow
        return tied[0], min(1.0, margin), margin < self.narrow


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", dict_bytes: int = DICT_BYTES, pieces: int = SAMPLE_PIECES, piece: int = PIECE, languages: int = LANGUAGES) -> LanguageModel:
    """Dictionaries from a bounded sample of the labelled rows of ``df``: whole texts are cut into pieces of ``piece`` characters, and each language gets the ``pieces`` different ones with the smallest hash of text and piece number, as many as fit ``dict_bytes``.

    Every part of a text is as likely to be drawn as any other; ids say nothing, copies of a text count once. Rows with a null
    text or language are left out. At most ``languages`` languages are learned, those of the most rows, so a dirty column
    can't fill the driver; with many of them each gets fewer pieces, so that no more than SAMPLE_CHARS characters are drawn.
    """
    rows = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    n_pieces = F.ceil(F.char_length("text") / piece).cast("int")
    counts = rows.where(n_pieces > 0).groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not counts:
        return LanguageModel({})
    most = max(1, min(2 * pieces, SAMPLE_CHARS // (len(counts) * piece)))
    known = rows.where(F.col("lang").isin([r.lang for r in counts]) & (n_pieces > 0)).withColumn("th", F.xxhash64("text"))
    numbers = F.transform(F.sequence(F.lit(0), n_pieces - 1), lambda i: F.struct(i.alias("at"), F.xxhash64("th", i).alias("h")))
    hashes = known.select("lang", F.explode(F.transform(numbers, lambda x: x["h"])).alias("h")).distinct()  # numbers alone are shuffled
    chosen = hashes.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("nth") <= most).select("lang", "h")  # languages * most rows
    each = known.select("lang", "text", F.explode(numbers).alias("x")).select("lang", "text", "x.*").join(F.broadcast(chosen), ["lang", "h"])
    found = each.groupBy("lang", F.substring("text", F.col("at") * piece + 1, F.lit(piece)).alias("text")).agg(F.min("h").alias("h")).collect()
    drawn: dict[str, dict[bytes, None]] = {}
    size: dict[str, int] = {}
    for r in sorted(found, key=lambda r: (r.lang, r.h, r.text)):
        own, data = drawn.setdefault(r.lang, {}), folded(r.text)
        if len(own) < pieces and data not in own and _LETTER.search(r.text) and size.get(r.lang, 0) + len(data) <= dict_bytes:
            own[data] = None
            size[r.lang] = size.get(r.lang, 0) + len(data)
    return LanguageModel({lang: b"".join(parts) for lang, parts in drawn.items() if parts})


def identify(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred``, ``score``, ``rejected``: one row per row of ``df``, repeated rows too.

    A null text or one without a letter is ``und`` with score 0 and rejected, as is every text if the model knows no
    language. Whole texts count. No other column of ``df`` is read or carried.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            got = [model.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())], names=["id", "lang_pred", "score", "rejected"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def keep_identified(df: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, with all its columns, whose text is not rejected."""
    schema = df.schema
    at = df.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([not model.predict(t)[2] for t in b.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, schema)
