"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of texts in that language. A text
is compressed once with every dictionary; the smallest result names the language. The score
is the relative margin to the second smallest; a text whose margin is narrow is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from corpusq.llm.arrow_text import by_slice

# Bounds of the labelled sample the dictionaries are made of, for each language: documents
# (chosen by a hash of their id), and characters of each.
SAMPLE_DOCS = 256
SAMPLE_CHARS = 1200
MAX_LABELS = 100_000    # their counts are sent to every executor
LEVEL = 6
MIN_MARGIN = 0.002
UNKNOWN = "und"

NO_LETTERS = regex.compile(r"\P{L}+")
PREDICTION = "struct<lang_pred: string, score: double, rejected: boolean>"
_KIND = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()),
                   ("rejected", pa.bool_())])


def plain(text: str) -> bytes:
    """What is compressed: lower-cased letters, everything between words one blank."""
    return NO_LETTERS.sub(" ", text.lower()).strip().encode()


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def learn_dictionaries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS,
                       sample_chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """Dictionary of each label from a bounded sample of labelled rows.

    The sample is chosen from ids and labels alone; only its texts are then read. At most
    sample_docs * sample_chars characters a language reach the driver.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
                          & F.col(id_col).isNotNull())
    by_hash = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 32)), "id")
    named = labelled.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"),
                            F.xxhash64(F.col(id_col)).alias("h"))
    # hashes are even: twice the wanted share of them holds enough rows, and few
    size = named.groupBy("lang").agg(F.count(F.lit(1)).alias("c"))   # one row a label
    if size.count() <= MAX_LABELS:
        size = F.broadcast(size)
    few = named.join(size, "lang").where(
        F.pmod("h", F.lit(1 << 32)).cast("double") * F.col("c")
        <= float(1 << 33) * (sample_docs + 20))
    chosen = few.withColumn("n", F.row_number().over(by_hash)).where(
        F.col("n") <= sample_docs)
    ids = [r["id"] for r in chosen.select("id").collect()]
    if not ids:
        return {}
    rows = labelled.where(F.col(id_col).isin(ids)).select(
        F.col(lang_col), F.xxhash64(F.col(id_col)),
        F.substring(F.col(text_col), 1, sample_chars)).collect()
    parts: dict[str, dict[bytes, None]] = {}
    for lang, _, text in sorted(map(tuple, rows)):
        parts.setdefault(lang, {}).setdefault(plain(text))   # copies count once
    return {lang: b" ".join(texts) for lang, texts in parts.items()}


class Classifier:
    def __init__(self, dictionaries: tuple[tuple[str, bytes], ...], min_margin: float):
        self.min_margin = min_margin
        self.by_lang = []
        for lang, content in dictionaries:
            held = zstandard.ZstdCompressionDict(
                content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(content) >= 8 else None
            if held:
                held.precompute_compress(level=LEVEL)
            self.by_lang.append((lang, zstandard.ZstdCompressor(
                level=LEVEL, dict_data=held, write_content_size=False)))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        data = plain(text) if text else b""
        if not data or not self.by_lang:
            return UNKNOWN, 0.0, True
        sizes = sorted((len(c.compress(data)), lang) for lang, c in self.by_lang)
        if len(sizes) == 1:
            return sizes[0][1], 1.0, False
        margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        return sizes[0][1], margin, margin < self.min_margin


@cache
def classifier(dictionaries: tuple[tuple[str, bytes], ...], min_margin: float) -> Classifier:
    return Classifier(dictionaries, min_margin)


def language(text: Column, dictionaries: dict[str, bytes],
             min_margin: float = MIN_MARGIN) -> Column:
    """Predicted language, score and rejection of a text column.

    A null text, or one without letters, is `und` with score 0, rejected; so is every text
    when no language has been learned. Equal sizes go to the label first in order.
    """
    known = tuple(sorted(dictionaries.items()))

    @F.arrow_udf(PREDICTION)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        judge = classifier(known, min_margin)

        def work(part: pa.Array) -> pa.Array:
            langs, scores, rejected = zip(*map(judge.predict, part.to_pylist()), strict=True)
            return pa.StructArray.from_arrays(
                [pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(rejected, pa.bool_())], fields=list(_KIND))

        for texts in batches:
            yield by_slice(texts, work, _KIND)
    # a filter on the prediction must not make the optimizer predict twice
    return predict.asNondeterministic()(text)


def identify_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      lang_col: str = "lang", min_margin: float = MIN_MARGIN) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: one row per input row.

    Dictionaries come from rows outside the held-out third (crc32 of the id, modulo 3, is 1)
    that have a label. A null id is not held out and not learned from. Other columns than the
    three named are not looked at.
    """
    held_out = F.coalesce(fold(F.col(id_col)) == 1, F.lit(False))
    dictionaries = learn_dictionaries(docs.where(~held_out), id_col, text_col, lang_col)
    return docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"),
                       language(F.col(text_col), dictionaries, min_margin).alias("_r")
                       ).select("doc_id", "held_out", "_r.*")
