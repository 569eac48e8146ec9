"""The stored search index: segments of zoned texts and block postings.

A segment sorts its chunks by (library, length) and cuts them into zones of
about ZONE chunks. `texts` holds the chunks in zone order, so that the text of a
few hits is a few row groups. `postings` has one row for each (term, library,
zone): the occurrences, and the largest count and smallest length in them, which
bound every score in the zone. Its files are split by a hash of the term and
sorted by it; a zone's row is bounded, so a term that all chunks hold is many rows.

A change is a delta: a new segment, the ids of older chunks that it replaces, and
how many chunks of each term and library went with them, so that statistics
stay exact. Readers follow the newest manifest entry, which is written last.
`merge` turns all segments into one.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..session import shuffles_freed

#: Chunks of a zone; a power of two.
ZONE = 256
BUCKETS = 64
PLACE = ("library", "id", "path", "collection", "heading", "start_line", "end_line")
TERM_ROWS = "term string, library string, zone bigint, id bigint, dl bigint, tf bigint, positions array<int>"
POSTING_ROWS = "term string, library string, zone bigint, docs array<struct<id:bigint,dl:bigint,tf:bigint,positions:array<int>>>, max_tf bigint, min_dl bigint, n bigint"
#: Term rows that a task turns into blocks at once, some more with the zone they end in.
BLOCK_ROWS = 1_000_000
#: The index is read rarely against its size; ids recur in most rows of a zone.
STORED = {"compression": "zstd", "parquet.dictionary.page.size": str(4 << 20)}
MANIFEST = "version string, at timestamp, segments array<string>, buckets int"


def bucket_of(term: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Index:
    """The segments of one version, oldest first."""

    spark: SparkSession
    root: str
    segments: tuple[str, ...]
    buckets: int

    def table(self, name: str) -> DataFrame:
        """The rows of all segments with the number of their segment."""
        parts = [self.spark.read.parquet(f"{self.root}/segments/{s}/{name}").withColumn("segment", F.lit(n)) for n, s in enumerate(self.segments)]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def gone(self) -> DataFrame:
        """(segment, library, id) of chunks that a later segment replaces."""
        numbers = self.spark.createDataFrame(list(enumerate(self.segments)), "segment int, name string")
        return self.table("gone").drop("segment").join(F.broadcast(numbers), "name").select("segment", "library", "id")

    def live(self, rows: DataFrame) -> DataFrame:
        """Rows of (segment, library, id, ...) that no later segment replaces."""
        return rows.join(self.gone(), ["segment", "library", "id"], "left_anti") if len(self.segments) > 1 else rows

    def places(self) -> DataFrame:
        """Where the live chunks stand, without their texts."""
        return self.live(self.table("texts").select("segment", "zone", *PLACE))

    def stats(self) -> DataFrame:
        """library, n, avgdl over the live chunks."""
        whole = self.table("stats").groupBy("library").agg(F.sum("n").cast("double").alias("n"), F.sum("total").alias("total"))
        return whole.where("n > 0").select("library", "n", (F.col("total") / F.col("n")).alias("avgdl"))

    def postings(self, terms: list[str]) -> DataFrame:
        """Posting rows of the terms; the bucket prunes files, the term row groups."""
        spark = self.spark
        if not terms:
            return self.table("postings").where(F.lit(False))
        wanted = spark.createDataFrame([(t,) for t in terms], "t string").select(bucket_of("t", self.buckets)).distinct().collect()
        return self.table("postings").where(F.col("bucket").isin([r[0] for r in wanted]) & F.col("term").isin(terms))

    def less(self, terms: list[str]) -> DataFrame:
        """term, library, less: chunks to take off a term's count."""
        return self.table("less").where(F.col("term").isin(terms)).groupBy("term", "library").agg(F.sum("less").alias("less"))

    def texts_of(self, hits: list) -> DataFrame:
        """library, id, content of a few rows (segment, zone, library, id): whole files and row groups are left out."""
        rows = self.table("texts").select("segment", "zone", "library", "id", "content")
        return rows.where(F.col("zone").isin(sorted({h.zone for h in hits})) & F.col("id").isin(sorted({h.id for h in hits}))).select("segment", "library", "id", "content")


def _tokens() -> Column:
    return tx.search_tokens(F.col("content"))


def _term_rows(batches: Iterator) -> Iterator:
    """One row for each term of a chunk with its positions. A chunk is one row, so its terms need no shuffle."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        for at in range(0, batch.num_rows, ZONE):
            part = batch.slice(at, ZONE)
            tokens = part.column("tokens")
            sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype("int64")
            terms = tokens.flatten().dictionary_encode()
            if not len(terms):
                continue
            row, pos = np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            code = terms.indices.to_numpy(zero_copy_only=False).astype("int64")
            key = row * len(terms.dictionary) + code
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            ends = np.append(first, len(order))
            positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pos[order], pa.int32()))
            of = pa.array(row[order][first])
            columns = [terms.dictionary.take(pa.array(code[order][first])), *[part.column(c).take(of) for c in ("library", "zone", "id", "dl")], pa.array(np.diff(ends)), positions]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "library", "zone", "id", "dl", "tf", "positions"])


def _hashes(terms) -> "np.ndarray":  # noqa: F821
    """xxhash64 of an Arrow array of strings as Spark has it, for all terms of a length at once."""
    import numpy as np
    import pyarrow as pa

    p1, p2, p3, p4, p5 = (np.array([p], "u8") for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    mixed = lambda x: turned(x * p2, 31) * p1
    terms = terms.cast(pa.large_binary())
    ends = np.frombuffer(terms.buffers()[1], "i8", len(terms) + 1, terms.offset * 8)
    every, sizes = np.frombuffer(terms.buffers()[2] or b"", "u1"), np.diff(ends)
    out, seed = np.zeros(len(terms), "u8"), np.array([42], "u8")
    for size in np.unique(sizes):
        of = np.flatnonzero(sizes == size)
        text, at = every[ends[of][:, None] + np.arange(size)], 0
        word = lambda at, n: np.ascontiguousarray(text[:, at:at + n]).view(f"<u{n}")[:, 0].astype("u8")
        if size >= 32:
            lanes = [seed + p1 + p2, seed + p2, seed, seed - p1]
            for at in range(0, size - 31, 32):
                lanes = [turned(v + word(at + 8 * k, 8) * p2, 31) * p1 for k, v in enumerate(lanes)]
            at += 32
            h = sum(turned(v, n) for v, n in zip(lanes, (1, 7, 12, 18)))
            for v in lanes:
                h = (h ^ mixed(v)) * p1 + p4
        else:
            h = np.repeat(seed + p5, len(of))
        h = h + np.uint64(size)
        while at + 8 <= size:
            h, at = turned(h ^ mixed(word(at, 8)), 27) * p1 + p4, at + 8
        if at + 4 <= size:
            h, at = turned(h ^ (word(at, 4) * p1), 23) * p2 + p3, at + 4
        for k in range(at, size):
            h = turned(h ^ (text[:, k].astype("u8") * p5), 11) * p1
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        out[of] = h ^ (h >> np.uint64(32))
    return out.view("i8")


def _packed(numbers) -> tuple:
    """Numbers from 0 on by bytes: all lowest ones first, which compress best."""
    import numpy as np

    kind = np.min_scalar_type(int(numbers.max())) if len(numbers) else np.dtype("u1")
    return kind.str, np.ascontiguousarray(numbers.astype(kind).view("u1").reshape(len(numbers), kind.itemsize).T).tobytes()


def _unpacked(kind: str, data: bytes) -> "np.ndarray":  # noqa: F821
    import numpy as np

    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, "u1").reshape(size, -1).T).view(kind).reshape(-1).astype("i8")


def _blocks(table, buckets: int) -> Iterator:
    """The postings of whole zones from their term rows, one compressed block for each bucket.

    Should an id come twice in a zone, its entries become one.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    table = table.combine_chunks()
    column = lambda c: table.column(c).combine_chunks()
    terms = column("term").dictionary_encode()
    of_term = _hashes(terms.dictionary) % buckets
    by_bucket = np.argsort(of_term, kind="stable")
    of_term, place = of_term[by_bucket], np.argsort(by_bucket)
    code = place[terms.indices.to_numpy()]

    known = lambda c: pc.fill_null(column(c).dictionary_encode().indices, -1).to_numpy().astype("i8")
    run = np.cumsum(np.append(0, (np.diff(known("library")) != 0) | (np.diff(known("zone")) != 0)))
    ident = known("id") + 1
    _, first, row = np.unique(run * (ident.max() + 1) + ident, return_index=True, return_inverse=True)
    key = code * len(first) + row
    order = np.argsort(key, kind="stable")
    entry = np.flatnonzero(np.diff(key[order], prepend=-1))
    of_entry, entry_row = code[order][entry], row[order][entry]
    lists = column("positions").take(pa.array(order))
    tf, pos = np.add.reduceat(column("tf").to_numpy()[order], entry), lists.flatten().to_numpy().astype("i8")
    token = np.append(0, np.cumsum(tf))
    if len(entry) < len(order):
        pos = pos[np.lexsort((pos, np.repeat(np.arange(len(tf)), tf)))]
    gap = np.diff(pos, prepend=0)
    gap[token[:-1]] = pos[token[:-1]]
    entry_run = run[first][entry_row]
    posting = np.flatnonzero(np.append(True, (np.diff(of_entry) != 0) | (np.diff(entry_run) != 0)))
    docs, of_posting = np.diff(np.append(posting, len(entry))), of_entry[posting]
    for b in np.unique(of_term):
        words = np.searchsorted(of_term, [b, b + 1])
        p, e = (slice(*np.searchsorted(codes, words)) for codes in (of_posting, of_entry))
        term, (rows, at) = of_posting[p] - words[0], np.unique(entry_row[e], return_inverse=True)
        names = terms.dictionary.take(pa.array(by_bucket[slice(*words)]))
        places = [column(c).take(pa.array(first[rows])) for c in ("library", "zone", "id", "dl")]
        # Terms ascend from posting to posting, so that their differences are small, as are those of positions.
        block = pickle.dumps((names, places, *map(_packed, (np.diff(term, prepend=0), docs[p], at, tf[e], gap[token[e.start]:token[e.stop]]))), 5)
        yield int(b), len(block).to_bytes(8, "little") + pa.compress(block, codec="zstd", asbytes=True)


def _term_blocks(buckets: int):
    """Texts in zone order to blocks of postings. A zone's postings are made where it is read, so that no term rows are shuffled."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def out(held: list) -> Iterator:
            for bucket, block in _blocks(pa.Table.from_batches(held), buckets):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([block], pa.binary())], names=["bucket", "block"])

        held, size = [], 0
        for part in _term_rows(batches):
            if size >= BLOCK_ROWS:
                # Blocks end where a zone does, which may go on in this part.
                others = np.flatnonzero(part.column("zone").to_numpy() != held[-1].column("zone")[-1].as_py())
                if len(others):
                    yield from out([*held, part.slice(0, others[0])])
                    part, held, size = part.slice(others[0]), [], 0
            held.append(part)
            size += part.num_rows
        if held:
            yield from out(held)

    return run


def _posting_rows(batches: Iterator) -> Iterator:
    """The rows of blocks, a row for each (term, library, zone)."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for block in batch.column("block").to_pylist():
            names, places, *packed = pickle.loads(pa.decompress(block[8:], int.from_bytes(block[:8], "little"), codec="zstd", asbytes=True))
            term, docs, at, tf, gap = (_unpacked(*p) for p in packed)
            library, zone, ident, dl = (p.take(pa.array(at)) for p in places)
            start, entry, first = (np.append(0, np.cumsum(x)) for x in (docs, tf, gap))
            pos = first[1:] - np.repeat(first[entry[:-1]], tf)
            positions = pa.ListArray.from_arrays(pa.array(entry, pa.int32()), pa.array(pos, pa.int32()))
            entries = pa.StructArray.from_arrays([ident, dl, pa.array(tf), positions], ["id", "dl", "tf", "positions"])
            of = pa.array(start[:-1])
            least = np.minimum.reduceat(dl.to_numpy(zero_copy_only=False), start[:-1])
            yield pa.RecordBatch.from_arrays([names.take(pa.array(np.cumsum(term))), library.take(of), zone.take(of), pa.ListArray.from_arrays(pa.array(start, pa.int32()), entries),
                                              pa.array(np.maximum.reduceat(tf, start[:-1])), pa.array(least.astype("i8")), pa.array(docs)],
                                             names=["term", "library", "zone", "docs", "max_tf", "min_dl", "n"])


def _write_segment(chunks: DataFrame, base: str, buckets: int) -> DataFrame:
    """texts and postings of a segment; its statistics are returned.

    Only texts and compressed blocks of postings are shuffled, one after the
    other. A large bucket is several tasks, as its blocks can be split anywhere.
    """
    spark = chunks.sparkSession
    order = ["library", "dl", "id"]
    sized = chunks.withColumn("dl", F.size(_tokens()).cast("long")).repartitionByRange(*order).sortWithinPartitions(*order)
    sized.withColumn("zone", F.shiftright(F.monotonically_increasing_id(), ZONE.bit_length() - 1)).write.options(**STORED).parquet(f"{base}/texts")
    texts = spark.read.parquet(f"{base}/texts")
    blocks = texts.select("library", "zone", "id", "dl", _tokens().alias("tokens")).mapInArrow(_term_blocks(buckets), "bucket int, block binary")
    rows = blocks.hint("rebalance", "bucket").mapInArrow(_posting_rows, POSTING_ROWS)
    keys = ["bucket", "term", "library", "zone"]
    rows.withColumn("bucket", bucket_of("term", buckets)).sortWithinPartitions(*keys).write.options(**STORED).partitionBy("bucket").parquet(f"{base}/postings")
    return texts.groupBy("library").agg(F.count("*").alias("n"), F.sum("dl").alias("total"))


def _publish(spark: SparkSession, root: str, segments: tuple[str, ...], buckets: int) -> Index:
    entry = spark.range(1).select(F.lit(uuid.uuid4().hex).alias("version"), F.current_timestamp().alias("at"), F.array(*[F.lit(s) for s in segments]).alias("segments"), F.lit(buckets).alias("buckets"))
    entry.coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return Index(spark, root, segments, buckets)


def _none(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], {"gone": "name string, library string, id bigint", "less": "term string, library string, less bigint"}[name])


def write_index(chunks: DataFrame, root: str, buckets: int = BUCKETS) -> Index:
    """A new index of one segment. `chunks`: PLACE columns and content; ids are unique in a library."""
    name = uuid.uuid4().hex
    base = f"{root}/segments/{name}"
    with shuffles_freed(chunks.sparkSession):
        _write_segment(chunks.select(*PLACE, "content"), base, buckets).write.parquet(f"{base}/stats")
        for empty in ("gone", "less"):
            _none(chunks.sparkSession, empty).write.parquet(f"{base}/{empty}")
    return _publish(chunks.sparkSession, root, (name,), buckets)


def read_index(spark: SparkSession, root: str) -> Index:
    """The newest version."""
    entry = spark.read.schema(MANIFEST).parquet(f"{root}/manifest").orderBy(F.col("at").desc()).first()
    return Index(spark, root, tuple(entry.segments), entry.buckets)


def add_segment(index: Index, chunks: DataFrame, replaced: DataFrame) -> Index:
    """A delta: `chunks` come, all chunks of the (library, path) rows of `replaced` go.

    The cost is that of the chunks that come and go, and of a read of the
    places; postings that stay are not touched.
    """
    spark, name = index.spark, uuid.uuid4().hex
    base = f"{index.root}/segments/{name}"
    with shuffles_freed(spark):
        added = _write_segment(chunks.select(*PLACE, "content"), base, index.buckets)
        going = index.places().join(replaced.select("library", "path").distinct(), ["library", "path"], "left_semi").select("segment", "zone", "library", "id")
        names = spark.createDataFrame(list(enumerate(index.segments)), "segment int, name string")
        going.join(F.broadcast(names), "segment").select("name", "library", "id", "zone").write.parquet(f"{base}/gone")
        gone = spark.read.parquet(f"{base}/gone").join(F.broadcast(names), "name").drop("name")
        texts = index.table("texts").join(gone, ["segment", "zone", "library", "id"], "left_semi")
        terms = texts.select("library", F.explode(F.array_distinct(_tokens())).alias("term"))
        terms.groupBy("term", "library").agg(F.count("*").alias("less")).sort("term").write.parquet(f"{base}/less")
        lost = texts.groupBy("library").agg((-F.count("*")).alias("n"), (-F.sum("dl")).alias("total"))
        added.unionByName(lost).write.parquet(f"{base}/stats")
    return _publish(spark, index.root, (*index.segments, name), index.buckets)


def merge(index: Index) -> Index:
    """All live chunks as one segment; the older segments stay for readers that still use them."""
    live = index.live(index.table("texts").select("segment", *PLACE, "content"))
    return write_index(live, index.root, index.buckets)
