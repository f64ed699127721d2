"""Documents whose word shingles have a Jaccard similarity of 0.75 or more.

Sets that similar differ in few shingles: of sizes ``a`` and ``b`` in at most
``(a + b) / 7``. The universe of shingles is dealt by hash into more segments
than that, so some segment is equal in both, and sets that share no segment
need not be compared. The number of segments depends on a band of sizes; a set
takes part in the level of its own band and in that of the next larger one.

A set needs one more segment than it may have differences, and may choose which:
- of those beyond that all but ``RESERVE`` are left out at the start, by an order
  that two sets have in common: those with fewest shingles, which sets without a
  link share most often. A pair shares so many more segments than it needs, by either
  set's count, as that set has to spare. The set that ends first in the order loses
  at most what it leaves out, so both still share more than either's reserve;
- empty segments are never used, their buckets would be the largest;
- sets with too many empty ones use one-deletion neighbourhoods of the others
  instead, each of which covers two differences; those for which even these are
  too few all meet, and have them too, for partners that rely on theirs;
- a segment costs its bucket, the sets that have it, known exactly once the
  segments are grouped. Buckets whose sets are already of one component cost
  nothing. Of the others, large ones are left unused while the rest suffices,
  and then compared, the smallest first, block by block. That is done in rounds
  of rising size: what a round links makes larger buckets one component, and
  these need not be compared any more.

Either set of a pair may be the one that finds it. Every link is verified on
the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spokeworks.llm.batches import columns, mixed, shingle_sets, slices
from spokeworks.llm.components import components
from spokeworks.operators.staging import stage

WIDTH = 5
#: Jaccard similarity as a fraction of whole numbers.
ALIKE, OF = 75, 100
SPARE = 1.1  # segments for each difference to be covered
RESERVE = 4  # rows of a kind that a set keeps beyond those it needs, so as to leave some buckets unused
KINDS = 4  # of rows of a set: of two levels, whole segments and neighbourhoods
HOW = 10  # bits for a row's kind and margin
PAIRED = 4  # sets of a bucket that are paired at once
SMALL = 24  # sets of a bucket that are paired if not of one component yet
BLOCK = 1024  # sets of a larger bucket that meet another block in a task
GROWTH = 4  # times as large as before are the buckets of the next round
KNOWN_BYTES = 32 << 20  # texts and sets that a task keeps while it verifies pairs
KNOWN_IDS = 2_000_000  # ids that are broadcast, with their components 32 MB; more are joined by a shuffle
COARSE = 32  # bytes of a parity sketch above which pairs are first told apart by half its bits
FEW_PAIRS = 250_000  # pairs whose ids are broadcast as they are, repeated
_SKETCH = "doc_id bigint, n bigint, high bigint, low bigint, bits binary"


def differences(a, b):
    """Most shingles by which linked sets of these sizes can differ."""
    return (a + b) * (OF - ALIKE) // (OF + ALIKE)


def band_starts(most: int) -> np.ndarray:
    """First size of each band; a set's partners lie in its band and those beside it."""
    starts = [1]
    while starts[-1] <= most:
        starts.append(starts[-1] * OF // ALIKE + 1)
    return np.array(starts, np.int64)


_STARTS = band_starts(1 << 40)
_VALUE = np.uint64(0xA5A5A5A5A5A5A5A5)


@lru_cache(maxsize=4096)
def levels(n: int) -> list[tuple[int, int, int]]:
    """``level, segments, allowance`` of a set of ``n`` shingles, for its own band and the next.

    The allowance is how many differences from any partner have to be covered.
    A level's smaller sets meet its own band's sets only, so each pair is met at
    the level of its larger set.
    """
    band = int(np.searchsorted(_STARTS, n, side="right")) - 1
    out = []
    for level in (band, band + 1):
        top = int(_STARTS[level + 1]) - 1
        segments = max(1, int(np.ceil(SPARE * (differences(top, top) + 1))))
        out.append((level, segments, int(differences(n, min(top, n * OF // ALIKE)))))
    return out


def _segments(hashes: np.ndarray, level: int, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment of each shingle, and of each segment the sum of its shingles' values and their number."""
    with np.errstate(over="ignore"):
        place = (mixed(hashes + np.uint64(level + 1)) >> np.uint64(33)) % np.uint64(segments)
        place = place.astype(np.int64)
        order = np.argsort(place, kind="stable")
        value = mixed(hashes ^ _VALUE)
        running = np.concatenate([[np.uint64(0)], np.cumsum(value[order])])
        number = np.bincount(place, minlength=segments)
        ends = np.cumsum(number)
        return place, running[ends] - running[ends - number], number


def _signature(total: np.ndarray, segment: np.ndarray, level: int | np.ndarray, number: np.ndarray) -> np.ndarray:
    """48 bits: most of what is shuffled, and sets that meet by chance are told apart like all others."""
    with np.errstate(over="ignore"):
        key = mixed(np.uint64(level) * np.uint64(0x9E3779B97F4A7C15) + segment.astype(np.uint64))
        return (mixed(mixed(total + key) + number.astype(np.uint64)) >> np.uint64(16)).view(np.int64)


def _sketch(hashes: np.ndarray) -> tuple[int, int, bytes]:
    """128 bits that stand for the whole set, and the parity of its shingles in about twice as many bits.

    Each bit in which two parities differ takes a shingle that only one set has:
    differing bits are a lower bound of the differing shingles.
    """
    with np.errstate(over="ignore"):
        high = int(mixed(hashes ^ np.uint64(1)).sum(dtype=np.uint64).view(np.int64))
        low = int(mixed(hashes ^ np.uint64(2)).sum(dtype=np.uint64).view(np.int64))
    bits = parity_bits(len(hashes))
    count = np.bincount((hashes >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits)
    return high, low, np.packbits(count.astype(np.uint8) & 1).tobytes()


def parity_bits(n: int) -> int:
    """Bits of a parity sketch: alike for all sets of bands that may meet, about twice the size."""
    return 64 if n <= 32 else 1 << int(np.ceil(np.log2(2 * n)))


def folded(bits: bytes, size: int) -> np.ndarray:
    """A parity sketch brought to a smaller size: parities of places that fall together add up."""
    out = np.frombuffer(bits, np.uint8)
    while len(out) > size:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def _coarse(sketched: DataFrame) -> DataFrame:
    """``doc_id, n, bits`` with half the bits of each sketch of more than ``COARSE`` bytes."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [folded(x, max(COARSE, len(x) // 2)).tobytes() for x in batch.column("bits").to_pylist()]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("n"), pa.array(bits, pa.binary())], names=["doc_id", "n", "bits"]
            )

    return sketched.select("doc_id", "n", "bits").mapInArrow(task, "doc_id bigint, n bigint, bits binary")


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, n, high, low, bits`` of each row: size and sketches of its set of shingles."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, bounds = shingle_sets(batch.column(1).to_pylist(), WIDTH)
            sets = [hashes[i:j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            rows = [(len(x), *(_sketch(x) if len(x) else (0, 0, b""))) for x in sets]
            n, high, low, bits = zip(*rows, strict=True)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.record_batch(
                [batch.column(0), *(pa.array(x, k) for x, k in zip((n, high, low, bits), kinds, strict=True))],
                names=["doc_id", "n", "high", "low", "bits"],
            )

    return docs.mapInArrow(task, _SKETCH)


def _whole(hashes: np.ndarray, bounds: np.ndarray, above: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of the segments of all sets at one of their levels, their sets, and each set's margin.

    The segments of all sets are numbered through, so one sort groups the shingles of all. Of a
    margin above ``RESERVE`` the segments with fewest shingles are left out.
    """
    sizes = np.diff(bounds)
    of = np.array([levels(n)[above] if n else (0, 1, 0) for n in sizes.tolist()], np.int64).reshape(-1, 3)
    level, segments, allowed = of.T
    base = np.cumsum(segments) - segments
    doc = np.repeat(np.arange(len(sizes)), sizes)
    with np.errstate(over="ignore"):
        place = (mixed(hashes + level.astype(np.uint64)[doc] + np.uint64(1)) >> np.uint64(33)) % segments.astype(np.uint64)[doc]
        place = base[doc] + place.astype(np.int64)
        order = np.argsort(place, kind="stable")
        place = place[order]
        starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else place
        total = np.add.reduceat(mixed(hashes ^ _VALUE)[order], starts) if len(place) else hashes
    own = doc[order][starts]
    number = np.diff(np.append(starts, len(place)))
    used = np.bincount(own, minlength=len(sizes))
    margin = used - (allowed + 1)
    left = used - np.maximum(margin - RESERVE, 0)
    order = np.lexsort((-number, own))  # stable, so equal numbers stay in the order of their segments
    kept = np.sort(order[np.arange(len(own)) - (np.cumsum(used) - used)[own] < left[own]])
    total, own, number, place = total[kept], own[kept], number[kept], place[starts][kept]
    sig = _signature(total, place - base[own], level[own].astype(np.uint64), number)
    return sig, own, np.minimum(margin, RESERVE)


def _neighbourhoods(hashes: np.ndarray, above: int) -> Iterator[tuple[np.ndarray, int]]:
    """Signatures of the one-deletion neighbourhoods of a set that has too few segments, with their margin."""
    level, segments, allowed = levels(len(hashes))[above]
    place, total, number = _segments(hashes, level, segments)
    used = np.flatnonzero(number)
    with np.errstate(over="ignore"):
        less = total[place] - mixed(hashes ^ _VALUE)
    near = number[place] > 1
    sig = np.concatenate(
        [
            _signature(total[used], used, level, number[used]),
            _signature(less[near], place[near], level, number[place][near] - 1),
        ]
    )
    # a lone shingle's neighbourhood is the empty segment, which isn't used
    margin = 2 * int((number > 1).sum()) + int((number == 1).sum()) - (allowed + 1)
    yield ~sig, margin
    if margin < 0:  # too few even so: such sets of a level all meet, others find them by the rows above
        yield ~_signature(np.zeros(1, np.uint64), np.zeros(1, int), level, np.zeros(1, int)), 0


def _signatures(docs: DataFrame) -> DataFrame:
    """``sig_how, doc_id``: a row for each segment, or for its one-deletion neighbourhood.

    These rows are most of what is shuffled, so ``sig_how`` is the signature with ``HOW`` bits
    below it for ``KINDS * (margin + 1) + kind``.
    ``kind`` is even for whole segments and odd for neighbourhoods, 0 and 1 in
    the level above the set's own band and 2 and 3 in its own; ``margin`` is how many
    differences more than needed the rows of a kind cover (-1: too few).
    """

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 256):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            hashes, bounds = shingle_sets(batch.column(1).to_pylist(), WIDTH)
            out: list[list[np.ndarray]] = [[], []]

            def add(sig, own, kind, margin, out=out, ids=ids):
                out[0].append((sig << HOW) + (np.clip(margin, -1, 127) + 1) * KINDS + kind)
                out[1].append(ids[own])

            for above in (0, 1):
                sig, own, margin = _whole(hashes, bounds, above)
                add(sig, own, 2 - 2 * above, margin[own])
                for i in np.flatnonzero((margin < 0) & (np.diff(bounds) > 0)).tolist():
                    for sig, covered in _neighbourhoods(hashes[bounds[i] : bounds[i + 1]], above):
                        add(sig, np.full(len(sig), i), 3 - 2 * above, np.full(len(sig), covered))
            yield pa.record_batch([pa.array(np.concatenate(x), pa.int64()) for x in out], names=["sig_how", "doc_id"])

    return docs.mapInArrow(task, "sig_how bigint, doc_id bigint")


def _meet(kind_a, kind_b):
    """Whether a pair is to be met here: one set at least is of the level's own band."""
    return (kind_a >= 2) | (kind_b >= 2)


def _buckets(signatures: DataFrame) -> DataFrame:
    """Buckets of two sets and more; small ones as pairs ``doc_id, other``, of others all rows.

    Rows come sorted by signature, so a bucket is a run; what is carried from
    batch to batch is a run of at most ``PAIRED`` rows.
    """

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, large = None, None
        for batch in _with_end(batches):
            if batch is None:
                rows = carried
            else:
                both, ids = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                how = both & ((1 << HOW) - 1)
                rows = [both >> HOW, ids, (how % KINDS).astype(np.int8), (how // KINDS - 1).astype(np.int8)]
                if carried is not None:
                    rows = [np.concatenate(x) for x in zip(carried, rows, strict=True)]
            carried = None
            if rows is None or not len(rows[0]):
                continue
            sig = rows[0]
            starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            lengths = np.diff(np.append(starts, len(sig)))
            many = lengths > PAIRED
            if large is not None and sig[0] == large:
                many[0] = True
            large = None
            if batch is not None:  # the last run may go on
                if many[-1]:
                    large = sig[-1]
                else:
                    carried = [x[starts[-1] :] for x in rows]
                    starts, lengths, many = starts[:-1], lengths[:-1], many[:-1]
            out = []
            for k in range(2, PAIRED + 1):
                first = starts[(lengths == k) & ~many]
                for i in range(k):
                    for j in range(i + 1, k):
                        a, b = first + i, first + j
                        own = _meet(rows[2][a], rows[2][b]) & (rows[1][a] != rows[1][b])
                        a, b = rows[1][a[own]], rows[1][b[own]]
                        out.append((None, np.minimum(a, b), np.maximum(a, b), None, None))
            kept = np.zeros(len(sig) + 1, np.int64)
            np.add.at(kept, starts[many], 1)
            np.add.at(kept, starts[many] + lengths[many], -1)
            kept = np.flatnonzero(np.cumsum(kept[:-1]))
            out.append((sig[kept], rows[1][kept], None, rows[2][kept], rows[3][kept]))
            for part in out:
                n = len(part[1])
                if n:
                    yield pa.record_batch(
                        [pa.nulls(n, t) if x is None else pa.array(x, t) for x, t in zip(part, _BUCKET_TYPES, strict=True)],
                        names=["sig", "doc_id", "other", "kind", "margin"],
                    )

    ordered = signatures.repartition(F.shiftright("sig_how", HOW)).sortWithinPartitions("sig_how")
    return ordered.mapInArrow(task, "sig bigint, doc_id bigint, other bigint, kind byte, margin byte")


_BUCKET_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int8(), pa.int8())


def _with_end(batches):
    yield from batches
    yield None


def _only(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Documents with (``left_semi``) or without (``left_anti``) the ids; few enough ids are broadcast."""
    if ids.count() <= KNOWN_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, "doc_id", how)


def _ids(pairs: DataFrame, label: str) -> tuple[DataFrame, bool]:
    """``doc_id`` of the written pairs' sets, and whether these are few enough for a broadcast.

    Ids of few pairs are left as they are, repeated; of more they are made distinct by a shuffle.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    if pairs.count() <= FEW_PAIRS and 2 * FEW_PAIRS <= KNOWN_IDS:
        return ids, True
    ids = stage(ids.distinct(), label)
    return ids, ids.count() <= KNOWN_IDS


def _likely(pairs: DataFrame, sketched: DataFrame) -> DataFrame:
    """``a, b, apart`` of the pairs that their sizes and parities don't rule out.

    Where the pairs' ids are few enough they pick the sketches that are shuffled, with half their bits:
    sets that have little in common differ by more than a link allows even so.
    """
    ids, few = _ids(pairs, "ngram-likely-ids")
    if few:
        sketched = sketched.join(F.broadcast(ids), "doc_id", "left_semi")
    sketched = _coarse(sketched)
    left = sketched.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
    right = sketched.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
    both = pairs.join(left, "a").join(right, "b").where(
        (F.least("na", "nb") * OF >= F.greatest("na", "nb") * ALIKE)
    )

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, None, 4096):
            na, nb = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb"))
            apart = np.array(
                [_apart(x, y) for x, y in zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist(), strict=True)],
                np.int64,
            )
            keep = apart <= differences(na, nb)
            yield pa.record_batch(
                [batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep)), pa.array(apart[keep])],
                names=["a", "b", "apart"],
            )

    return both.select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(task, "a bigint, b bigint, apart bigint")


def _apart(x: bytes, y: bytes) -> int:
    size = min(len(x), len(y))
    return (int.from_bytes(folded(x, size).tobytes()) ^ int.from_bytes(folded(y, size).tobytes())).bit_count()


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """``a, b, shared, united`` of the pairs that link, by the whole texts' sets.

    A pair comes once for each two texts that its ids' rows have.
    """
    pairs = stage(pairs.select("a", "b"), "ngram-pairs")
    ids, few = _ids(pairs, "ngram-ids")
    texts = stage(docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi"), "ngram-texts")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        held = 0
        for batch in slices(batches, "text_b", 256):
            rows = []
            given = [c.to_pylist() for c in batch.columns]
            fresh = [t for t in {*given[2], *given[3]} if t not in known]
            if held > KNOWN_BYTES:  # texts come sorted by one side's id, so most are asked for again soon
                known, held, fresh = {}, 0, list({*given[2], *given[3]})
            hashes, bounds = shingle_sets(fresh, WIDTH)
            for i, t in enumerate(fresh):
                known[t] = hashes[bounds[i] : bounds[i + 1]]
                held += len(t or "") + 8 * len(known[t])
            for a, b, x, y in zip(*given, strict=True):
                x, y = known[x], known[y]
                shared = len(np.intersect1d(x, y, assume_unique=True))
                united = len(x) + len(y) - shared
                if united and OF * shared >= ALIKE * united:
                    rows.append((a, b, shared, united))
            columns_ = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns_], names=["a", "b", "shared", "united"])

    return both.mapInArrow(task, "a bigint, b bigint, shared bigint, united bigint")


def _connect(pairs: DataFrame, parts: DataFrame | None, sketched: DataFrame, docs: DataFrame) -> DataFrame:
    """The components, joined by those of the pairs that link.

    At the start each set's likeliest pair is verified; then, and later, whatever
    pair still lies between two components: within one nothing can change.
    """
    likely = stage(_likely(stage(pairs, "ngram-met"), sketched), "ngram-likely")
    if parts is None:
        best = likely.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("best")).select("best.a", "b")
        parts = _parts(verified(best, docs).select("a", "b"))
    rest = (
        _labelled(_labelled(likely, parts, "a", "part_a"), parts, "b", "part_b")
        .where("part_a <> part_b")
        .select("a", "b")
    )
    return _connect_all(rest, parts, docs)


def _connect_all(pairs: DataFrame, parts: DataFrame, docs: DataFrame) -> DataFrame:
    """The components, joined by all pairs that link; pairs lie between two components."""
    links = stage(verified(pairs, docs).select("a", "b"), "ngram-links")
    if links.isEmpty():
        return parts
    return _parts(links.unionByName(_stars(parts)))


def _parts(links: DataFrame) -> DataFrame:
    """The written components; if they are few enough, joins broadcast them and move no rows."""
    parts = stage(components(links), "ngram-parts")
    return F.broadcast(parts) if parts.count() <= KNOWN_IDS else parts


def _stars(parts: DataFrame) -> DataFrame:
    """Components as links of each node with the smallest."""
    return parts.select(F.col("node").alias("a"), F.col("component").alias("b"))


def _labelled(rows: DataFrame, parts: DataFrame, column: str, name: str) -> DataFrame:
    """Rows with the component of a column's set, which is the set itself where it has no link."""
    named = parts.select(F.col("node").alias(column), F.col("component").alias(name))
    return rows.join(named, column, "left").withColumn(name, F.coalesce(name, column))


def _open(members: DataFrame, parts: DataFrame) -> DataFrame:
    """``sig, doc_id, kind, margin, size, part``: rows of the buckets that hold sets of several components."""
    labelled = _labelled(members, parts, "doc_id", "part")
    spread = labelled.groupBy("sig").agg(
        F.count("*").alias("size"), F.min("part").alias("low"), F.max("part").alias("high")
    )
    return labelled.join(spread.where("low <> high").select("sig", "size"), "sig").select(
        "sig", "doc_id", "kind", "margin", "size", "part"
    )


def _small_pairs(open_: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of open buckets of up to ``SMALL`` sets."""
    small = open_.where(F.col("size") <= SMALL)
    a = small.select("sig", F.col("doc_id").alias("a"), F.col("part").alias("part_a"), F.col("kind").alias("kind_a"))
    b = small.select("sig", F.col("doc_id").alias("b"), F.col("part").alias("part_b"), F.col("kind").alias("kind_b"))
    return (
        a.join(b, "sig")
        .where((F.col("a") < F.col("b")) & (F.col("part_a") != F.col("part_b")) & _meet(F.col("kind_a"), F.col("kind_b")))
        .select("a", "b")
    )


def _asking(open_: DataFrame) -> DataFrame:
    """Rows of open buckets of more than ``SMALL`` sets with ``asks`` and ``asker``: whether the set
    can't do without the bucket, and whether it can't without some bucket.

    Open buckets count as unused; a set that has more of them than its margin allows takes
    the smallest, those of earlier rounds first. Buckets that were compared before and are
    still open stay in the count, so what a set takes only gets less from round to round.
    All windows run over one shuffle by set.
    """
    cost = F.when(F.col("kind") % 2 == 0, 1).otherwise(2)
    of_kind, of_set = Window.partitionBy("doc_id", "kind"), Window.partitionBy("doc_id")
    needed = F.count("*").over(of_kind) - F.floor(F.col("margin") / cost)
    place = F.row_number().over(of_kind.orderBy("size", "sig"))
    asks = (F.col("margin") >= 0) & (F.col("place") <= F.col("needed"))
    return (
        open_.where(F.col("size") > SMALL)
        .repartition("doc_id")
        .withColumns({"needed": needed, "place": place})
        .withColumn("asks", asks)
        .withColumn("asker", F.max("asks").over(of_set))
        .select("sig", "doc_id", "kind", "margin", "size", "part", "asks", "asker")
    )


def _block_pairs(rows: DataFrame, sketched: DataFrame) -> DataFrame:
    """Pairs of a bucket's asking sets with its members that their parities don't rule out.

    ``rows`` are some of ``_asking``. A set that doesn't ask finds all its partners by itself if
    its rows there have a margin, so askers have to meet each other and the sets without one (-1).
    A bucket's sets are dealt into blocks of about ``BLOCK``, and a task row is one block's
    askers against another block; pairs exist inside the row only. These rows are dealt
    by bucket and block, so a large bucket is many tasks' work; a bucket of one block
    stays where it was written. Two sets that
    both ask for a bucket are one pair there. An id whose rows have several texts is met by
    the sketches of each.
    """
    wanted = rows.where("margin < 0 OR asker")
    sized = wanted.groupBy("sig").agg(F.max("asks").alias("any"), F.ceil(F.count("*") / BLOCK).alias("blocks"))
    sketch = _only(sketched.select("doc_id", "n", "bits"), wanted.select("doc_id").distinct(), "left_semi").repartition("doc_id").distinct()
    dealt = (
        wanted.join(sized.where("any").select("sig", "blocks"), "sig")
        .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
        .join(sketch, "doc_id")
    )
    each = F.struct("doc_id", "kind", "part", "n", "bits", "asks")
    blocks = stage(
        dealt.groupBy("sig", "block", "blocks").agg(F.collect_list(each).alias("members"), F.max("asks").alias("any")),
        "ngram-blocks",
    )
    asks = F.filter("members", lambda m: m["asks"]).alias("asking")
    asking = blocks.where("any AND blocks > 1").select(
        "sig", asks, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block")
    )
    both = asking.join(blocks.where("blocks > 1").select("sig", "block", "members"), ["sig", "block"])
    both = both.select("asking", "members").unionByName(blocks.where("blocks = 1").select(asks, "members"))

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, None, 1):
            x, y = batch.column("asking")[0].as_py(), batch.column("members")[0].as_py()
            size = min(len(r["bits"]) for r in x + y)
            bits = [np.array([folded(r["bits"], size) for r in side]).view(np.uint64) for side in (x, y)]
            value = {c: [np.array([r[c] for r in side]) for side in (x, y)] for c in ("doc_id", "kind", "part", "n", "asks")}
            na, nb = value["n"]
            out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i in range(len(x)):
                apart = np.bitwise_count(bits[0][i] ^ bits[1]).sum(axis=1)
                near = (apart <= differences(na[i], nb)) & (value["part"][0][i] != value["part"][1])
                near &= np.minimum(na[i], nb) * OF >= np.maximum(na[i], nb) * ALIKE
                near &= _meet(value["kind"][0][i], value["kind"][1])
                near &= ~value["asks"][1] | (value["doc_id"][0][i] < value["doc_id"][1])
                found = value["doc_id"][1][near]
                out_a.append(np.full(len(found), value["doc_id"][0][i]))
                out_b.append(found)
            a, b = np.concatenate(out_a), np.concatenate(out_b)
            yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return both.mapInArrow(task, "a bigint, b bigint")


def _in_rounds(members: DataFrame, parts: DataFrame, sketched: DataFrame, docs: DataFrame) -> DataFrame:
    """The components, joined through open buckets: small ones at once, larger ones by rising size.

    After a round without a link the open buckets, and who asks for them, are those of the round before.
    """
    open_ = stage(_open(members, parts), "ngram-open")
    pairs, above, upto, asking = None, SMALL, SMALL * GROWTH, None
    while True:
        if pairs is None:
            before, parts = parts, _connect(_small_pairs(open_).distinct(), parts, sketched, docs)
        else:  # blocks have told them apart by all bits
            before, parts = parts, _connect_all(pairs.distinct(), parts, docs)
        if parts is not before:
            open_ = stage(_open(open_.select("sig", "doc_id", "kind", "margin"), parts), "ngram-open")
        if asking is None or parts is not before:
            asking = stage(_asking(open_), "ngram-asking")
        left = asking.where(F.col("size") > above)
        least = left.where("asks").agg(F.min("size").alias("size")).first()["size"]
        if least is None:
            return parts
        while upto < least:  # no round without buckets
            upto *= GROWTH
        pairs = _block_pairs(left.where(F.col("size") <= upto), sketched)
        above, upto = upto, upto * GROWTH


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row of ``doc_id, text``.

    Sets are of distinct five-word shingles, of the whole sequence with fewer
    words. The component is the smallest id reachable by links, the own id
    included. Null or empty text, or one without words, has an empty set and
    links with nothing. A row without an id has no component. Rows that share an
    id stand for one node, linked by any of their texts. Other columns are
    ignored; an empty table stays empty.

    Equal sets are first made one by a 128-bit sum over their shingles, so the
    copies of a text meet nobody twice.
    """
    own = columns(docs, doc_id="bigint", text="string")
    sketched = stage(sketches(own), "ngram-sketches")
    full = sketched.where("n > 0 AND doc_id IS NOT NULL")
    firsts = full.groupBy("n", "high", "low").agg(F.min("doc_id").alias("first"))
    copies = stage(
        full.join(firsts, ["n", "high", "low"])
        .groupBy("doc_id")
        .agg(F.collect_set("first").alias("firsts"))
        .where((F.size("firsts") > 1) | (F.col("firsts")[0] != F.col("doc_id"))),
        "ngram-copies",
    )
    # an id whose rows have several texts keeps its rows
    only_copies = copies.where(F.size("firsts") == 1).select("doc_id")
    single = _only(own.where("doc_id IS NOT NULL"), only_copies, "left_anti")
    buckets = stage(_buckets(_signatures(single)), "ngram-buckets")

    members = buckets.where("other IS NULL").select("sig", "doc_id", "kind", "margin")
    lead = F.min(F.struct((-F.col("kind")).alias("kind"), F.col("doc_id").alias("c"))).alias("lead")
    centres = members.groupBy("sig").agg(lead).where("lead.kind <= -2").select("sig", "lead.c")
    stars = (
        members.join(centres, "sig")
        .where("c <> doc_id")
        .select(F.least("c", "doc_id").alias("a"), F.greatest("c", "doc_id").alias("b"))
    )
    paired = buckets.where("other IS NOT NULL").select(F.col("doc_id").alias("a"), F.col("other").alias("b"))
    parts = _connect(paired.unionByName(stars).distinct(), None, full, own)
    parts = _in_rounds(members, parts, full, own)

    if copies.where(F.size("firsts") > 1).isEmpty():  # a copy is of its first set's component
        held = _labelled(copies.select("doc_id", F.col("firsts")[0].alias("node")), parts, "node", "component")
        every = parts.unionByName(held.select(F.col("doc_id").alias("node"), "component"))
    else:
        named = copies.select(F.col("doc_id").alias("a"), F.explode("firsts").alias("b"))
        every = components(_stars(parts).unionByName(named))
    every = every.withColumnsRenamed({"node": "doc_id", "component": "found"})
    return sketched.join(every, "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("found", "doc_id").alias("component_id")
    )


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The documents with all their columns, of each class the one with the smallest id only.

    Documents without words or without an id are kept; of rows that share an id
    one is.
    """
    found = stage(classes(docs), "ngram-classes")
    dropped = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = _only(docs, stage(dropped, "ngram-dropped"), "left_anti")
    repeated = stage(
        found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id"), "ngram-repeated"
    )
    if not repeated.isEmpty():
        once = _only(kept, repeated, "left_semi").dropDuplicates(["doc_id"])
        kept = _only(kept, repeated, "left_anti").unionByName(once)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
