"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

- A shingle is five words of a document, unchanged; a shorter document with a word is one shingle.
- Its weight is tf * (1 + ln(N / df) / (2 ln N)): N documents, df of them with the shingle, counted over all
  documents. Shared passages count less, yet copies in large groups stay similar.
- Two documents are linked if the weighted Jaccard similarity, sum of smaller weights / sum of larger weights,
  reaches the threshold. Links are checked on the weights; a class is a connected component of links.

Candidates: each document gives bands * rows consistent weighted samples. A sample keeps the least ln a of the
shingles, a value that the shingle and its quantized weight t determine, and hence stands for both. Documents
that agree on all samples of a band meet in a bucket: at similarity 0.8, 14 bands of 4 miss 0.06 % of pairs. Documents
that meet others give SAMPLES more, PLANES bits of each; pairs are candidates if no more samples differ in their bits than at
the threshold plus 3.5 standard deviations, which misses another 0.02 %.

- Documents whose shingles that occur elsewhere weigh less than the threshold of their whole weight cannot
  have a partner and skip the buckets; this is exact, as common shingles hold that share of both documents.
- Documents with the same shingles and counts are collapsed by a 128-bit key before they meet buckets.
- Each candidate is compared with the least row of all its buckets, so a large group of near copies takes one pair a row, not one
  for each bucket; linked rows are one group. Then those of other groups are compared with the least row of each bucket, its
  pivot. A bucket with members of other groups gets other pivots, one among these and DRAWS among all its rows, so that rows
  meet ever new members of a large group; PIVOTS times in all, while groups merge across buckets. Then
  all candidate pairs of different groups that still share a bucket are compared, each in the first band they share, so
  that none is left out; members of one group are connected and need no more links. No bucket is gathered.

Each row gives one row; repeated rows are copies of each other. Null and empty texts, and texts of white space, are
classes of their own. class_id is the least doc_id of a class; null ids count only if there is no other. An empty
table gives no rows. A very long text is a chunk by itself and is treated whole, by one task at a time. Other columns are not
looked at, and stay as they are in `one_of_each`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm import tally
from flowlens.llm.common import ROW_BITS, land, lean, packed_size, packed_texts, thawed, whole_rows
from flowlens.llm.components import components

U64 = np.uint64
SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 14, 4
SAMPLES, PLANES = 1024, 4
# Times that open buckets get other pivots before all open pairs are compared, and pivots drawn among all rows of a bucket.
PIVOTS, DRAWS = 5, 3
# Bits of a shingle's key.
BITS = 48
# Random (r, beta, ln c) that keys are hashed to, shared by all samples.
TABLE_BITS = 18
SKETCH = "row long, doc_id long, key binary, bands array<long>, payload binary"


class Tables:
    """Random (r, beta, ln c) and, for each step of weights met so far, ln a of all of them: one for each worker."""

    def __init__(self):
        rng = np.random.Generator(np.random.PCG64(20))
        n = 1 << TABLE_BITS
        self.r = -np.log(rng.random(n) * rng.random(n))
        self.log_c = np.log(-np.log(rng.random(n) * rng.random(n)))
        self.beta = rng.random(n)
        self.flat = np.zeros(0, np.float32)
        self.place: dict[int, int] = {}

    def places(self, steps: np.ndarray) -> np.ndarray:
        """Where the values of each step begin in `flat`."""
        new = [s for s in steps.tolist() if s not in self.place]
        for s in new:
            self.place[s] = len(self.place) << TABLE_BITS
        if new:
            self.flat = np.concatenate([self.flat, *(self._values(s) for s in new)])
        return np.array([self.place[s] for s in steps.tolist()], U64)

    def _values(self, step: int) -> np.ndarray:
        log_w = step / 20 if step < 20 else 1 + (step - 20) / 5
        t = np.floor(log_w / self.r + self.beta)
        return (self.log_c - self.r * (t - self.beta) - self.r).astype(np.float32)


class Sampler:
    """Consistent weighted samples. Weights enter in steps of 5 %, beyond e of 20 %, so that ln a of all
    table entries is held for each step; the check of links uses the weights as they are."""

    def __init__(self, tables: Tables, samples: int, seed: int):
        self.tables = tables
        drawn = np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, samples, dtype=np.uint64)
        self.factors = drawn * U64(2) + U64(1)

    def samples(self, keys: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(samples, documents): the least ln a of each document's shingles."""
        log_w = np.log(weights)
        steps = np.where(log_w < 1, np.round(log_w * 20), 20 + np.round((log_w - 1) * 5)).astype(np.int64)
        names, which = np.unique(steps, return_inverse=True)
        offset = self.tables.places(names)[which]
        flat = self.tables.flat
        spread = keys * U64(0x9E3779B97F4A7C15)
        spread ^= spread >> U64(29)
        out = np.empty((len(self.factors), len(starts)), np.float32)
        for k, factor in enumerate(self.factors):
            out[k] = np.minimum.reduceat(flat[offset + ((spread * factor) >> U64(64 - TABLE_BITS))], starts)
        return out


_HELD: dict = {}


def sampler(samples: int, seed: int) -> Sampler:
    """One for each worker and set of samples; all share their tables."""
    if (samples, seed) not in _HELD:
        if "tables" not in _HELD:
            _HELD["tables"] = Tables()
        _HELD[samples, seed] = Sampler(_HELD["tables"], samples, seed)
    return _HELD[samples, seed]


def shingles(texts_column, size: int, bits: int = BITS):
    """Distinct (document, key) ascending, and counts: doc, key, tf."""
    from flowlens.llm.words import grams, mix, split, texts

    data, offsets = texts(texts_column)
    words = split(data, offsets)
    hashes = words.hashes()
    at, keys = grams(hashes, words.doc, size)
    doc = words.doc[at]
    per_doc = words.per_doc()
    first = np.cumsum(per_doc) - per_doc
    short = np.flatnonzero((per_doc > 0) & (per_doc < size))
    if len(short):
        whole = np.empty(len(short), U64)
        for i, d in enumerate(short.tolist()):
            h = U64(per_doc[d])
            for j in range(int(per_doc[d])):
                h = mix((h ^ hashes[first[d] + j : first[d] + j + 1]) * U64(0x9E3779B97F4A7C15))[0]
            whole[i] = h
        doc, keys = np.concatenate([doc, short]), np.concatenate([keys, whole])
    keys = keys >> U64(64 - bits)
    order = np.lexsort((keys, doc))
    doc, keys = doc[order], keys[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])
    first = np.flatnonzero(new)
    return doc[first], keys[first], np.diff(np.append(first, len(doc)))


def _asked(packed: DataFrame, size: int, cut: int) -> DataFrame:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, keys, _ = shingles(thawed(blob).column("__text"), size)
                keys, counts = np.unique(keys, return_counts=True)
                yield from tally.requests(chunk, keys, counts, BITS, cut)

    return packed.select("chunk", "blob").mapInArrow(lean(ask), tally.REQUEST)


def _sketched(
    packed: DataFrame, n: int, n_bytes: int, size: int, threshold: float, bands: int, rows: int
) -> DataFrame:
    """SKETCH of each document; key, bands and payload only where a partner is possible."""
    cut = tally.bucket_bits(n_bytes // 6)
    log_n = float(np.log(max(n, 2)))
    rare = 1.5 if n > 1 else 1.0

    def sketch(chunk: int, blob: bytes, df: np.ndarray) -> Iterator[pa.RecordBatch]:
        from flowlens.llm.words import mix

        table = thawed(blob)
        names = table.column("__id").combine_chunks()
        doc, keys, tf = shingles(table.column("__text"), size)
        distinct, which = np.unique(keys, return_inverse=True)
        df = df.astype(np.float64)[which]
        idf = np.where(df <= 1, rare, 1 + np.log(max(n, 2) / df) / (2 * log_n))
        weights = tf * idf
        out_key, out_bands, out_payload = ([None] * len(names) for _ in range(3))
        starts = np.flatnonzero(np.diff(doc, prepend=-1))
        if len(starts):
            whole = np.add.reduceat(weights, starts)
            shared = np.add.reduceat(np.where(df > 1, weights, 0.0), starts)
            may = shared >= threshold * whole * (1 - 1e-9)
            open_docs = np.flatnonzero(may)
            if len(open_docs):
                pick = np.repeat(may, np.diff(np.append(starts, len(doc))))
                d, k, w, t = doc[pick], keys[pick], weights[pick], tf[pick]
                begin = np.flatnonzero(np.diff(d, prepend=-1))
                signature = sampler(bands * rows, 21).samples(k, w, begin).view(np.uint32).astype(U64)
                signature = signature.reshape(bands, rows, -1)
                band = np.full((bands, len(begin)), U64(bands))
                for j in range(rows):
                    band = mix((band ^ signature[:, j]) * U64(0x9E3779B97F4A7C15))
                ends = np.append(begin, len(d))[1:]
                for i, (a, b) in enumerate(zip(begin.tolist(), ends.tolist(), strict=True)):
                    place = int(d[a])
                    packed_keys, counts = tally.squeeze_sorted(k[a:b]), t[a:b].astype("<u4").tobytes()
                    out_key[place] = xxhash.xxh3_128_digest(k[a:b].tobytes() + counts)
                    out_bands[place] = band[:, i].view(np.int64).tolist()
                    levels, at = np.unique(w[a:b], return_inverse=True)
                    out_payload[place] = _payload(packed_keys, levels, at)
        yield pa.record_batch(
            {
                "row": pa.array((chunk << ROW_BITS) + np.arange(len(names)), pa.int64()),
                "doc_id": names,
                "key": pa.array(out_key, pa.binary()),
                "bands": pa.array(out_bands, pa.list_(pa.int64())),
                "payload": pa.array(out_payload, pa.binary()),
            }
        )

    replies = tally.answers(_asked(packed, size, cut))
    return land(tally.answered(packed, [replies], sketch, SKETCH), "sketches")


def _payload(keys: bytes, levels: np.ndarray, at: np.ndarray) -> bytes:
    places = tally.squeeze(at)
    head = np.array([len(keys), len(levels)], "<u4").tobytes()
    return head + keys + levels.astype("<f8").tobytes() + places


def _weights(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n_keys, n_levels = np.frombuffer(payload, "<u4", 2).tolist()
    keys = tally.unsqueeze_sorted(payload[8 : 8 + n_keys])
    levels = np.frombuffer(payload, "<f8", n_levels, 8 + n_keys)
    return keys, levels[tally.unsqueeze(payload[8 + n_keys + 8 * n_levels :])]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two (keys, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    return float(common / (a[1].sum() + b[1].sum() - common))


def _compared(pairs: DataFrame, sketches: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """x, y, similarity for pairs x, y of rows; each document's weights come to the pair by hash join."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, held = None, None
            found = []
            for x, a, b in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if x != last:
                    last, held = x, _weights(a)
                found.append(similarity(held, _weights(b)))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["x", "y", "similarity"])

    side = sketches.select("row", "payload")
    rows = pairs.select("x", "y").join(side.select(F.col("row").alias("y"), F.col("payload").alias("b")), "y").join(
        side.select(F.col("row").alias("x"), F.col("payload").alias("a")), "x"
    )
    return rows.select("x", "y", "a", "b").mapInArrow(lean(compare), "x long, y long, similarity double")


def _marked(sketches: DataFrame) -> DataFrame:
    """row, bands and PLANES bits of each of SAMPLES further samples, plane by plane."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from flowlens.llm.words import mix

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                sets = [_weights(p) for p in part.column(2).to_pylist()]
                starts = np.cumsum([0, *(len(k) for k, _ in sets)])[:-1]
                found = sampler(SAMPLES, 22).samples(*(np.concatenate(x) for x in zip(*sets, strict=True)), starts)
                mixed = mix(found.view(np.uint32).astype(U64))
                planes = [np.packbits((mixed >> U64(63 - p)).astype(np.uint8) & 1, axis=0) for p in range(PLANES)]
                bits = np.ascontiguousarray(np.concatenate(planes).T).view("<i8")
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array(bits.tolist(), pa.list_(pa.int64()))], ["row", "bands", "bits"]
                )

    return sketches.select("row", "bands", "payload").mapInArrow(lean(mark), "row long, bands array<long>, bits array<long>")


def _may_link(a: str, b: str, threshold: float, exact: bool) -> Column:
    """Samples of a pair agree with the chance of its similarity, else all their bits do in one of 2 ** PLANES cases."""
    if exact:
        return F.lit(True)
    chance = (1 - threshold) * (1 - 0.5**PLANES)
    most = SAMPLES * chance + 3.5 * (SAMPLES * chance * (1 - chance)) ** 0.5
    words, apart = SAMPLES // 64, F.lit(0)
    for i in range(words):
        differ = [F.col(a)[p * words + i].bitwiseXOR(F.col(b)[p * words + i]) for p in range(PLANES)]
        apart += F.bit_count(reduce(lambda x, y: x.bitwiseOR(y), differ))
    return apart <= F.lit(int(most))


def _pivots(met: DataFrame, step: int) -> DataFrame:
    """band, hash, pivot, pivot_root, pivot_bits: of each bucket the least row; later DRAWS rows by hash, and one among those that
    are not of the least row's group."""
    of = F.struct("row", "root", "bits")
    if step <= 1:
        drawn = met.groupBy("band", "hash").agg(F.min_by(of, "row").alias("p"))
    else:
        order = [F.xxhash64("row", F.lit(step * (DRAWS + 1) + k)) for k in range(DRAWS + 1)]
        any_row = met.groupBy("band", "hash").agg(F.array(*[F.min_by(of, o) for o in order[:DRAWS]]).alias("ps"))
        least = met.groupBy("band", "hash").agg(F.min_by("root", "row").alias("least_root"))
        outside = met.join(least, ["band", "hash"]).where("root != least_root")
        other = outside.groupBy("band", "hash").agg(F.min_by(of, order[DRAWS]).alias("p"))
        drawn = any_row.select("band", "hash", F.explode(F.array_distinct("ps")).alias("p")).unionByName(other)
    return drawn.select("band", "hash", *[F.col(f"p.{c}").alias(n) for c, n in zip(("row", "root", "bits"), ("pivot", "pivot_root", "pivot_bits"), strict=True)])


def _pivot_pairs(met: DataFrame, marks: DataFrame, threshold: float, step: int, exact: bool) -> DataFrame:
    """Candidates x < y of which one is a pivot of a bucket of both. First of all, a row takes the least of its pivots alone."""
    rows = met.join(marks.select("row", "bits"), "row")
    pairs = rows.join(_pivots(rows, step), ["band", "hash"]).where(
        (F.col("root") != F.col("pivot_root")) & _may_link("bits", "pivot_bits", threshold, exact)
    )
    if step == 0:
        pairs = pairs.groupBy("row").agg(F.min("pivot").alias("pivot"))
    return pairs.select(F.least("row", "pivot").alias("x"), F.greatest("row", "pivot").alias("y")).distinct()


def _open_pairs(met: DataFrame, marks: DataFrame, threshold: float, bands: int, exact: bool) -> DataFrame:
    """Candidates x < y of different groups, each from the first band whose bucket they share."""
    rows = met.join(marks, "row")
    a, b = rows.alias("a"), rows.alias("b")
    agree = F.array(*[F.col("a.bands")[k] == F.col("b.bands")[k] for k in range(bands)])
    return a.join(
        b,
        (F.col("a.band") == F.col("b.band"))
        & (F.col("a.hash") == F.col("b.hash"))
        & (F.col("a.row") < F.col("b.row"))
        & (F.col("a.root") != F.col("b.root"))
        & _may_link("a.bits", "b.bits", threshold, exact)
        & (F.array_position(agree, True) == F.col("a.band") + 1),
    ).select(F.col("a.row").alias("x"), F.col("b.row").alias("y"))


def _merged(met: DataFrame, links: DataFrame) -> DataFrame:
    """Buckets that still have members of several groups, once each group has joined the least one it is linked with.

    That group may have joined another itself, which is followed once. So members of a group are connected, though
    connected rows may be of different groups.
    """
    known = met.select("row", "root").distinct()
    edges = links.join(known.toDF("x", "a"), "x").join(known.toDF("y", "b"), "y").where("a != b")
    least = land(edges.groupBy(F.greatest("a", "b").alias("root")).agg(F.min(F.least("a", "b")).alias("next")), "joined")
    after = least.toDF("next", "after")
    moved = least.join(after, "next", "left").select("root", F.coalesce("after", "next").alias("into"))
    met = met.join(moved, "root", "left").withColumn("root", F.coalesce("into", "root")).drop("into")
    mixed = met.groupBy("band", "hash").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    return met.join(mixed.where("low != high").select("band", "hash"), ["band", "hash"])


def linked(
    packed: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, exact: bool = False
) -> DataFrame:
    """row, doc_id, class_row, class_id, class_size of packed texts; class_row is the row that stays.

    exact: compare all pairs that share a bucket, whatever their sample bits.
    """
    n, n_bytes = packed_size(packed)
    sketches = _sketched(packed, n, n_bytes, size, threshold, bands, rows)
    keyed = sketches.where(F.col("key").isNotNull())
    same = land(keyed.groupBy("key").agg(F.min("row").alias("rep")), "copies")
    reps = keyed.join(same.select(F.col("rep").alias("row")), "row", "left_semi")
    held = reps.select("row", F.posexplode("bands").alias("band", "hash"))
    shared = held.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # Buckets with members of several groups; at first each document is a group.
    met = land(held.join(shared, ["band", "hash"]).withColumn("root", F.col("row")), "buckets")
    marks = land(_marked(reps.join(met.select("row").distinct(), "row", "left_semi")), "marks")
    step, links = 0, None
    while step <= PIVOTS and not met.isEmpty():
        last = step == PIVOTS
        pairs = _open_pairs(met, marks, threshold, bands, exact) if last else _pivot_pairs(met, marks, threshold, step, exact)
        if links is not None:
            pairs = pairs.join(links.select("x", "y"), ["x", "y"], "left_anti")
        compared = land(_compared(pairs, sketches).where(F.col("similarity") >= threshold).select("x", "y"), "links")
        step += 1
        if compared.isEmpty():
            step = max(step, PIVOTS)
            continue
        links = compared if links is None else links.unionByName(compared)
        if not last:
            met = land(_merged(met, compared), "buckets")
    roots = components(links, "x", "y") if links is not None else reps.select("row", F.col("row").alias("root")).limit(0)
    roots = land(roots.toDF("node", "root"), "roots")

    plain = sketches.select("row", "doc_id", "key").join(same, "key", "left")
    plain = plain.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    plain = plain.select("row", "doc_id", F.coalesce("root", "rep", "row").alias("class"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    classes = plain.groupBy("class").agg(first.alias("first"), F.count(F.lit(1)).alias("class_size"))
    return plain.join(classes, "class").select(
        "row", "doc_id", F.col("first.row").alias("class_row"), F.col("first.doc_id").alias("class_id"), "class_size"
    )


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """doc_id, class_id, class_size, stays: one row for each document."""
    packed = packed_texts(docs, id_col, text_col, "texts")
    found = linked(packed, **options)
    return found.select("doc_id", "class_id", "class_size", (F.col("row") == F.col("class_row")).alias("stays"))


def one_of_each(docs: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """The documents of which one of each class stays, with all their columns."""
    packed = packed_texts(docs, id_col, text_col, "texts", keep_columns=True)
    gone = linked(packed, **options).where("row != class_row")
    by_chunk = gone.groupBy(F.shiftright("row", ROW_BITS).alias("chunk")).agg(
        F.collect_list(F.col("row").bitwiseAND((1 << ROW_BITS) - 1)).alias("gone")
    )
    columns = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table = thawed(blob)
                stay = np.ones(table.num_rows, bool)
                stay[places or []] = False
                yield from whole_rows(table, columns, text_col, table.column("__text").combine_chunks(), stay)

    return packed.join(by_chunk, "chunk", "left").select("blob", "gone").mapInArrow(lean(keep), docs.schema)
