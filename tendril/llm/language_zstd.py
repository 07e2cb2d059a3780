"""Language ID by compression: the language whose raw-content dictionary makes a text smallest.

Each language gets a zstandard raw-content dictionary of about DICT_BYTES. It
is fitted on a bounded sample, whose bounds are parameters: `sample_rows`
labelled documents of each of the `max_languages` most frequent languages, by
hash order of their ids. Every sampled document gives an even share of the
dictionary: a run of folded bytes from a place that its hash picks, so neither
long documents nor beginnings are favoured. A text is folded to lower-case
letters and single spaces, cut into blocks that cover all of it, and compressed
once per language, at one level whatever its length; a slice of texts goes
through one dictionary after another. The relative gap between
the best two sizes is the margin; a narrow one is rejected.

Edge cases: a null text or one without a letter is `und` with score 0 and
rejected; ties go to the language with more training rows, then by name;
without any labelled row every text is `und`; with one language its margin is
1. Languages beyond the `max_languages` most frequent are not learnt, so their
texts get another verdict or a narrow margin. A row without an id is scored, is
not held out and teaches nothing; repeated rows score alike and count as often
as they stand there; very long texts are compressed block by block; an empty
table gives no rows. Columns of the input other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tendril.session import stored

from .common import arrow, fold_of, is_held_out
from .textvec import slices

DICT_BYTES = 110 << 10
#: Labelled documents per language that may fill a dictionary, and languages that are learnt.
SAMPLE_ROWS = 500
MAX_LANGUAGES = 200
LEVEL = 12
#: A dictionary's least bytes, which the format asks for; spaces fill those of languages of hardly a letter.
LEAST_DICT = 16
BLOCK = 8192
#: Below this relative gap between the two smallest sizes a verdict is rejected. Set from the margins of labelled
#: training rows on sf0.01: their 0.5 % quantile is 0.075, and all that are below 0.05 are ties of a few bytes.
MIN_MARGIN = 0.05
UNDETERMINED = "und"

KEEP_LETTERS = bytes(b if b >= 0x80 or 97 <= b <= 122 else 32 for b in range(256))
LETTER = regex.compile(r"\p{L}")


def folded(text: str) -> bytes:
    """Lower-case letters with single spaces between words."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(KEEP_LETTERS).split())


def share_of(data: bytes, doc_hash: int, size: int) -> bytes:
    """`size` bytes of whole words of a folded text, from a place that the hash picks; all of a shorter text."""
    if len(data) <= size:
        return data
    start = doc_hash % (len(data) - size + 1)
    piece = data[start : start + size]
    head = piece.find(b" ") if start and data[start - 1] != 32 else -1
    tail = piece.rfind(b" ") if start + size < len(data) and data[start + size] != 32 else size
    return piece[head + 1 : tail] if head < tail else piece


def fit(docs: DataFrame, folds: int = 5, held_out: int = 0, sample_rows: int = SAMPLE_ROWS, max_languages: int = MAX_LANGUAGES) -> dict[str, bytes]:
    """A dictionary for each language, from at most `sample_rows` labelled documents of each."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id"), folds) != held_out))
    # at most max_languages rows; ids may repeat, so their share goes by distinct ones (an estimate is enough for it)
    found_langs = known.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("doc_id").alias("ids")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()
    if not found_langs:
        return {}
    rows = {r["lang"]: r["n"] for r in found_langs}
    # about 4 * sample_rows ids of each language have a hash below its share, so the ranks below cost the same at any size
    share = F.create_map(*(x for r in found_langs for x in (F.lit(r["lang"]), F.lit(min(1.0, (4.0 * sample_rows + 40) / r["ids"])))))
    hashed = F.xxhash64(F.col("doc_id").cast("long"))
    near = known.select("doc_id", "lang").where(hashed.cast("double") / 2.0**64 + 0.5 <= share[F.col("lang")]).distinct()
    first = Window.partitionBy("lang").orderBy(hashed, "doc_id")
    # sample_rows ids per language: a size that is bounded by the parameters
    ids = stored(near.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= sample_rows).drop("_rank"), "sampled-ids")
    sampled = {r["lang"]: r["n"] for r in ids.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    texts = known.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"]).select("lang", "text", hashed.alias("_hash"))
    size = DICT_BYTES // sample_rows
    room = {k: max(size, DICT_BYTES // n) for k, n in sampled.items()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                lang, key = part.column("lang").to_pylist(), part.column("_hash").to_pylist()
                pieces = [share_of(folded(t), h & (1 << 62) - 1, room[k]) for k, t, h in zip(lang, part.column("text").to_pylist(), key, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("_hash"), pa.array(pieces, pa.binary())], ["lang", "_hash", "piece"])

    # at most max_languages dictionaries' bytes: texts stay in the tasks, pieces come; of ids that repeat, the least piece
    pieces = arrow(texts, cut, "lang string, _hash long, piece binary").groupBy("lang", "_hash").agg(F.min("piece").alias("piece"))
    found: dict[str, list[bytes]] = {}
    for row in pieces.orderBy("lang", "_hash").toLocalIterator():
        found.setdefault(row.lang, []).append(bytes(row.piece))
    return {k: b" ".join(found[k]).ljust(LEAST_DICT) for k in sorted(rows, key=lambda k: (-rows[k], k))}


def encoders(dictionaries: dict[str, bytes], level: int) -> list:
    """A compressing function for each dictionary."""
    out = []
    for raw in dictionaries.values():
        data = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=level)
        out.append(zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=False, write_dict_id=False).compress)
    return out


def blocks_of(data: bytes) -> list[bytes]:
    """The blocks of a folded text."""
    return [data] if len(data) <= BLOCK else [data[k : k + BLOCK] for k in range(0, len(data), BLOCK)]


class Classifier:
    """Compressors for all languages, the most frequent language first; sizes of one text under each."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = list(dictionaries)
        self.encoders = encoders(dictionaries, LEVEL)

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin)."""
        return self.many([text])[0]

    def many(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, score, margin) of each text.

        All texts go through one dictionary before the next is taken: its tables,
        1.5 MB at DICT_BYTES, then stay in the processor's cache.
        """
        out = [(UNDETERMINED, 0.0, 0.0)] * len(texts)
        known = [i for i, text in enumerate(texts) if text is not None and LETTER.search(text)] if self.names else []
        blocks = [blocks_of(folded(texts[i])) for i in known]
        sizes = [[sum(map(len, map(encode, own))) for own in blocks] for encode in self.encoders]
        for i, own in zip(known, zip(*sizes, strict=True), strict=True):
            out[i] = self.verdict(own)
        return out

    def verdict(self, sizes: tuple[int, ...]) -> tuple[str, float, float]:
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.names[0], 1.0, 1.0
        second = min(s for i, s in enumerate(sizes) if i != best)
        margin = (second - sizes[best]) / second
        return self.names[best], margin / (margin + 0.02), margin


OUT = "doc_id long, held_out boolean, lang_pred string, score double, margin double, rejected boolean"


def predict(docs: DataFrame, dictionaries: dict[str, bytes], folds: int = 5, held_out: int = 0, min_margin: float = MIN_MARGIN) -> DataFrame:
    """The language of each whole text; `rejected` marks texts without letters and narrow margins."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", is_held_out(F.col("doc_id"), folds, held_out).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(dictionaries).many
        for batch in batches:
            for part in slices(batch, "text"):
                got = classify(part.column("text").to_pylist())
                names, scores, margins = (list(x) for x in zip(*got, strict=True))
                rejected = [n == UNDETERMINED or m < min_margin for n, m in zip(names, margins, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names), pa.array(scores, pa.float64()), pa.array(margins, pa.float64()), pa.array(rejected)], ["doc_id", "held_out", "lang_pred", "score", "margin", "rejected"])

    return arrow(rows, run, OUT)


def keep_certain(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """The documents whose language is certain, with the columns of docs and lang set to the verdict."""
    names = docs.columns
    place = names.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(dictionaries).many
        for batch in batches:
            for part in slices(batch, "text"):
                got = classify(part.column("text").to_pylist())
                kept = pa.array([n != UNDETERMINED and m >= min_margin for n, _, m in got])
                part = part.set_column(place, part.schema.field(place), pa.array([n for n, _, _ in got], part.schema.field(place).type))
                yield part.filter(kept)

    return arrow(docs, run, docs.schema)
