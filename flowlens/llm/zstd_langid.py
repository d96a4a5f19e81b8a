"""Language ID by compression: the language whose dictionary makes a text smallest.

The languages with the most labelled documents, `max_langs` at most, each get a zstandard dictionary of raw content: whole
texts of labelled documents in the order of a hash, texts up to SHORT bytes before longer ones, as long as they fit into
`dict_bytes` together. That bounded sample is the model; a language none of whose texts fits is not learned. Texts are put
in lower case, and what lies between letters becomes one space. A text is cut into segments of SEGMENT bytes, all of which are
compressed with each dictionary, so a long text is judged whole and each part of it against fresh dictionaries. The margin is the
saving of the best language over the next, as a share of the next; below `margin` the document is rejected. So is one that the
best dictionary saves less than `saving` of its size without a dictionary, as noise is.

lang_pred is `und` if the text is null or has no letter, and rejected is then true. score is 1 - 2 ** -(margin * 100).
Ties go to the language with more labelled documents, then to the one that sorts first. With fewer than two learned languages
the margin is 1; with none, `und`. Each row gives one row, null ids and repeated rows too; a null id is not learned from. Empty
texts have no letter. An empty table gives no rows. `accepted` keeps the rows that are not rejected as they are, whatever
their columns are named.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import lean, ship

MAX_LANGS, DICT_BYTES = 128, 256 << 10
# Documents of a language that are looked at for its dictionary, and the bytes of a text that counts as short.
SAMPLE_DOCS, SHORT = 512, 4096
SEGMENT = 2048
LEVEL = 6
# Measured on sf0.1: of 1200 held-out texts 99 % have a margin of 0.064 or more, half-and-half mixtures of two languages 0.038 in
# the median; with a dictionary 99.5 % save 0.057 or more, random letters 0.031 at most, base64 0.027 at most.
MARGIN, SAVING = 0.04, 0.04
UNKNOWN = "und"


_BETWEEN = re.compile(r"[\W\d_]+")


def plain(text: str) -> bytes:
    return _BETWEEN.sub(" ", text.lower()).encode()


def dictionaries(labelled: DataFrame, max_langs: int = MAX_LANGS, dict_bytes: int = DICT_BYTES) -> list[tuple[str, bytes]]:
    """(language, raw content) from `doc_id`, `text`, `lang`, the most frequent language first.

    The best-ranked text stands last, where matches are near.
    """
    counts = labelled.where(F.col("lang").isNotNull()).groupBy("lang").count()
    langs = [tuple(r) for r in counts.orderBy(F.desc("count"), "lang").limit(max_langs).collect()]
    size = F.octet_length("text")
    usable = F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}") & (size <= dict_bytes)
    known = labelled.where(F.col("lang").isin([name for name, _ in langs]) & usable).withColumn("mark", F.xxhash64("text"))
    # Ranked by what is small; the texts of those chosen are looked up.
    drawn = known.select("lang", "doc_id", "mark", (size > SHORT).alias("long"), F.xxhash64("doc_id").alias("draw"), size.alias("size"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("long", "draw", "doc_id", "mark"))
    drawn = drawn.withColumn("rank", rank).where(F.col("rank") <= SAMPLE_DOCS)
    filled = F.sum("size").over(Window.partitionBy("lang").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    chosen = drawn.withColumn("filled", filled).where(F.col("filled") <= dict_bytes).select("lang", "doc_id", "mark", "rank")
    keys = ["lang", "doc_id", "mark"]
    rows = known.select(*keys, "text").join(F.broadcast(chosen), keys).dropDuplicates(["lang", "rank"]).select("lang", "rank", "text").collect()
    rows.sort(key=lambda r: -r["rank"])
    content: dict[str, list[bytes]] = {}
    for r in rows:
        content.setdefault(r["lang"], []).append(plain(r["text"]))
    return [(lang, b" ".join(content[lang])) for lang, _ in langs if lang in content]


class Judge:
    def __init__(self, content: list[tuple[str, bytes]]):
        import zstandard

        self.langs = [lang for lang, _ in content]
        self.bare = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.coders = []
        for _, raw in content:
            known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False))

    def sizes(self, text: bytes) -> list[int]:
        """With each dictionary, and last without one."""
        parts = [text[i : i + SEGMENT] for i in range(0, len(text), SEGMENT)]
        return [sum(len(c.compress(p)) for p in parts) for c in (*self.coders, self.bare)]

    def judge(self, text: str) -> tuple[str, float, float]:
        """Language, margin, and saving over no dictionary."""
        if not self.langs:
            return UNKNOWN, 0.0, 0.0
        *sizes, bare = self.sizes(plain(text).strip())
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        best = sizes[order[0]]
        saving = (bare - best) / bare
        if len(order) == 1:
            return self.langs[0], 1.0, saving
        after = sizes[order[1]]
        return self.langs[order[0]], (after - best) / after, saving


def _judging(docs: DataFrame, content: list[tuple[str, bytes]], margin: float, saving: float):
    """A function that gives language, margin and rejection of the texts of an Arrow column."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(content)  # max_langs * dict_bytes at most

    def judged(judge: Judge, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_pylist()
        found = [judge.judge(t.as_py()) if ok else (UNKNOWN, 0.0, 0.0) for t, ok in zip(texts, letters, strict=True)]
        gone = [lang == UNKNOWN or m < margin or saved < saving for lang, m, saved in found]
        return [f[0] for f in found], np.array([f[1] for f in found], np.float64), np.array(gone, bool)

    return lambda: Judge(shared.value), judged


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", **options) -> list[tuple[str, bytes]]:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return dictionaries(rows.where(~held_out(F.col("doc_id"))), **options)


def identify(
    docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", margin: float = MARGIN, saving: float = SAVING
) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, rejected: one row for each document."""
    start, judged = _judging(docs, learn(docs, id_col, text_col, lang_col), margin, saving)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = start()
        for batch in batches:
            langs, share, gone = judged(judge, batch.column(1))
            columns = [batch.column(0), pa.array(langs, pa.string()), pa.array(share), pa.array(gone)]
            yield pa.record_batch(columns, ["doc_id", "lang_pred", "margin", "rejected"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"doc_id {kind}, lang_pred string, margin double, rejected boolean").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "lang_pred",
        (1 - F.pow(F.lit(2.0), F.col("margin") * -100)).alias("score"),
        "margin",
        "rejected",
    )


def accepted(
    docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", margin: float = MARGIN, saving: float = SAVING
) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    start, judged = _judging(docs, learn(docs, id_col, text_col, lang_col), margin, saving)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = start()
        for batch in batches:
            yield batch.filter(pa.array(~judged(judge, batch.column(at))[2]))

    return docs.mapInArrow(lean(run), docs.schema)
