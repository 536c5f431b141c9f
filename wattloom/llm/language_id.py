"""Language identification by compression.

Every language gets a raw-content zstandard dictionary cut from its own training documents.
A text belongs to the language whose dictionary compresses it best. Sizes are whole bytes, so a narrow lead on a short
text is measured again on a finer scale, and is a rejection only where the scale is fine enough to show a lead.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattloom.llm.common import extended, id_remainder, reachable, read, worker_of

#: Documents of a language that its dictionary is cut from, and the characters each may give.
DOCS_PER_LANG = 256
CHARS_PER_DOC = 1024
#: Characters of all dictionaries together. Beyond, the languages share them: each gives fewer documents, then shorter pieces.
MODEL_CHARS = 256 * DOCS_PER_LANG * CHARS_PER_DOC
LEVEL, MIN_MATCH = 6, 3
#: Texts are compressed in pieces of this many bytes, so a long text does not become its own dictionary.
PIECE_BYTES = 8192
#: A lead under this share of the second best size is a rejection.
MIN_MARGIN = 0.002
#: Leads of at most SLACK bytes on texts whose sizes are too small to show MIN_MARGIN are measured again: the sizes by CUTS
#: parts of each dictionary (of CUT_BYTES at least) are summed, of the text repeated up to REPEAT_BYTES, as the format stores
#: a few bytes as they are.
SLACK, CUTS, CUT_BYTES, REPEAT_BYTES = 4, 16, 1024, 64
UNDETERMINED = "und"

SCHEMA = "lang_pred string, score double, rejected boolean"


def shares(languages: int) -> tuple[int, int]:
    """Documents that each language gives, and the characters of each document."""
    docs = min(DOCS_PER_LANG, max(1, MODEL_CHARS // (CHARS_PER_DOC * max(languages, 1))))
    return docs, min(CHARS_PER_DOC, max(1, MODEL_CHARS // (docs * max(languages, 1))))


def fit(train: DataFrame) -> dict[str, bytes]:
    """Raw dictionaries by language, the most frequent language first, from `train` (doc_id, text, lang).

    Rows with a null text, null lang or no letter teach nothing. The sample is fixed by a hash of the row, so reruns agree;
    so is the place of a document that its piece is cut at, as many may open alike. No usable row gives an empty model.
    """
    usable = train.select("doc_id", "text", "lang").where("lang is not null and text rlike '\\\\p{L}'")
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # a row for each language, as in the model
    docs, chars = shares(len(counts))
    places = F.greatest(F.length("text") - chars + 1, F.lit(1))
    piece = F.substring("text", (F.pmod(F.xxhash64(F.lit("place"), "doc_id", "text"), places) + 1).cast("int"), F.lit(chars))
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "piece")
    pieces = usable.select("lang", "doc_id", F.xxhash64("doc_id", "text").alias("h"), piece.alias("piece"))
    sample = pieces.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= docs)
    texts: dict[tuple[int, str], list[tuple[int, str]]] = {}
    for row in sample.select("lang", "rank", "piece").collect():  # at most MODEL_CHARS, or a character for each language
        texts.setdefault((-counts[row["lang"]], row["lang"]), []).append((row["rank"], row["piece"]))
    return {lang: "\n".join(x for _, x in sorted(rows)).lower().encode() for (_, lang), rows in sorted(texts.items())}


def compressor(raw: bytes) -> zstandard.ZstdCompressor:
    how = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=MIN_MATCH, write_checksum=0, write_content_size=0, write_dict_id=0)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)


class Language:
    """A language's compressor, and those of the cuts of its dictionary (made when first needed)."""

    def __init__(self, name: str, raw: bytes):
        self.name, self.raw, self.whole = name, raw, compressor(raw)

    @cached_property
    def cuts(self) -> list[zstandard.ZstdCompressor]:
        size = min(len(self.raw), max(len(self.raw) // CUTS, CUT_BYTES))
        return [compressor(self.raw[k * (len(self.raw) - size) // (CUTS - 1) :][:size]) for k in range(CUTS)]


def compressors(model: dict[str, bytes]) -> list[Language]:
    return [Language(lang, raw) for lang, raw in model.items()]


def classify(text: str | None, models: list[Language]) -> tuple[str, float, bool]:
    """Language, score and whether it is rejected. Score: the lead over the second best, as a share of the latter's size."""
    if not models or text is None or not any(c.isalpha() for c in text):
        return UNDETERMINED, 0.0, True
    data = text.lower().encode()
    pieces = [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
    sizes = sorted((sum(len(m.whole.compress(p)) for p in pieces), k) for k, m in enumerate(models))
    if len(sizes) == 1:
        return models[0].name, 1.0, False
    if sizes[1][0] * MIN_MARGIN < 1 and sizes[1][0] - sizes[0][0] <= SLACK:
        if len(data) < REPEAT_BYTES:
            pieces = [(data + b" ") * (1 + REPEAT_BYTES // len(data))]
        near = [k for size, k in sizes if size - sizes[0][0] <= SLACK]
        sizes = sorted((sum(len(z.compress(p)) for z in models[k].cuts for p in pieces), k) for k in near)
    margin = 1 - sizes[0][0] / sizes[1][0]
    return models[sizes[0][1]].name, margin, margin < MIN_MARGIN and sizes[1][0] * MIN_MARGIN >= 1


def identify(docs: DataFrame, model: dict[str, bytes]) -> DataFrame:
    """docs with lang_pred, score and rejected appended; one narrow pass over whole texts.

    Null texts and texts without a letter are `und`, score 0, rejected. Ties between languages go to the more frequent, then the smaller name.
    Columns of docs that clash with the appended names are replaced.
    """
    clash = [f.split()[0] for f in SCHEMA.split(", ")]
    base = docs.select([docs[c] for c in docs.columns if c not in clash])
    sent = base.sparkSession.sparkContext.broadcast(model)  # at most about MODEL_CHARS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_of("language_id")
        models = compressors(sent.value)
        for b in batches:
            rows = [classify(t, models) for t in b.column("text").to_pylist()]
            new = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *clash])

    return base.mapInArrow(run, extended(base.schema, SCHEMA))


def trained_on(docs: DataFrame) -> DataFrame:
    """The rows that may teach: crc32 of the id mod 3 is not 1."""
    return docs.where(id_remainder("doc_id", 3) != 1)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(trained_on(docs))
    found = identify(docs.select("doc_id", "text"), model)
    held = F.coalesce(id_remainder("doc_id", 3) == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without what is rejected: no letter, or no language clearly ahead."""
    reachable(spark)
    verdict = identify(docs, fit(trained_on(docs)))
    return verdict.where(~F.col("rejected")).select(docs.columns)


QUERIES = {"op10_language_id": query}
