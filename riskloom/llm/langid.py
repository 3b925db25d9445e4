"""Language identification by compression: the language whose dictionary shortens a text most wins.

Each language gets a raw-content zstandard dictionary made of pieces of labelled texts. A text is cut into
lower-cased blocks, every block is compressed with every dictionary, and the smallest total wins. A text is rejected
when the runner-up is nearly as small.

Defined cases: a null text or one without a letter gives `und`, score 0, rejected. Ties between languages
go to the one with more training rows, then to the smaller name, with score 0 and so rejected. Repeated
rows each get a row. Very long texts are read whole, block by block. Without any labelled row every text
is `und`. An empty table gives an empty result. Extra columns of the input are kept by `keep_identified`
and not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from . import _common as c

#: Labelled texts a language's dictionary is made of, at most (the bound of the training sample).
SAMPLES = 256
#: Bytes of a dictionary, at most.
DICT_BYTES = 1 << 16
BLOCK = 1 << 11
LEVEL = 5
#: Smallest share by which the winner must be shorter than the runner-up.
MARGIN = 0.002

_SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


def held_out(doc_id: str = "doc_id") -> Column:
    """Every fifth document by the crc32 of its id as text is kept from training."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, samples: int = SAMPLES, dict_bytes: int = DICT_BYTES) -> list[tuple[str, bytes]]:
    """(language, dictionary) by falling number of training rows.

    At most `samples` rows of each language are used, those with the smallest hash of their id; what is
    gathered on the driver is bounded by languages x dict_bytes.
    """
    usable = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    piece = _piece(max(64, dict_bytes // samples))
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "t")
    picked = usable.select("lang", "doc_id", piece.alias("t")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= samples)
    pieces: dict[str, dict[int, str]] = {}
    for r in picked.orderBy("lang", "doc_id", F.desc("k")).collect():  # samples x languages at most
        pieces.setdefault(r["lang"], {})[r["doc_id"]] = r["t"]
    found = []
    for row in counts:
        body = b"\n".join(x.lower().encode() for x in pieces[row["lang"]].values())[:dict_bytes]
        if len(body) >= 8:
            found.append((row["lang"], body))
    return found


def _piece(n: int) -> Column:
    """n characters from a place in the text that its id decides."""
    room = F.greatest(F.length("text") - n, F.lit(0)) + 1
    return F.substring("text", (F.pmod(F.xxhash64("doc_id"), room) + 1).cast("int"), F.lit(n))


def _judge(model: list[tuple[str, bytes]], block: int, level: int, margin: float):
    """A function from a text column to lists of languages, scores and rejections."""
    coders = []
    for lang, body in model:
        d = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        z = zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        coders.append((lang, z.compress))
    frame = len(coders[0][1](b"")) if coders else 0

    def judge(column: pa.Array) -> tuple[list[str], list[float], list[bool]]:
        langs, scores, narrow = [], [], []
        for text in column:
            text = text.as_py()
            if not coders or not text or not any(map(str.isalpha, text)):
                langs.append("und"), scores.append(0.0), narrow.append(True)
                continue
            raw = text.lower().encode()
            blocks = [raw[i : i + block] for i in range(0, len(raw), block)]
            sizes = [sum(len(f(x)) - frame for x in blocks) for _, f in coders]
            best = min(range(len(sizes)), key=sizes.__getitem__)
            second = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
            score = (second - sizes[best]) / max(second, 1)
            langs.append(coders[best][0]), scores.append(min(1.0, max(0.0, score))), narrow.append(score < margin)
        return langs, scores, narrow

    return judge


def predict(docs: DataFrame, model: list[tuple[str, bytes]], block: int = BLOCK, level: int = LEVEL, margin: float = MARGIN) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row; reads doc_id and text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(model, block, level, margin)
        for batch in batches:
            langs, scores, narrow = judge(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(narrow, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text", held_out().alias("held_out")).transform(c.in_arrow, run, _SCHEMA)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """The rows of docs whose language is told apart clearly, with docs' own columns."""
    c.small_batches(spark)
    model = train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(model, BLOCK, LEVEL, MARGIN)
        for batch in batches:
            yield batch.filter(pa.array([not x for x in judge(batch.column("text"))[2]], pa.bool_()))

    return docs.transform(c.in_arrow, run, docs.schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    return predict(docs, train(docs))
