"""Operator 8: removal of repeated byte strings, by column-wise construction over sampled stretches.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller
id. A collection's suffix order can be built column-wise: each round prepends one symbol to every
string and updates the order (the Burrows-Wheeler transform's rows) and the common prefixes. Built
over whole documents this takes as many rounds as the longest document has bytes and rewrites the
order of all suffixes in each. Only prefixes of ``length`` bytes decide here, and most strings have
no twin, so the construction is applied where it can matter:

1. Every window of ``length`` bytes is assigned to the least hash among its grams. Runs of windows
   with one such gram are stretches. Equal windows have the same gram, wherever they are.
2. Stretches meet by gram, packed into arrays. A gram of one document is done with. A stretch whose
   whole text is also in a smaller document is removed whole. The first one of each text remains.
3. Remaining stretches of a gram are taken up as strings: ``length`` rounds insert a column of all
   their windows each, last symbol first, and equal windows end up side by side. Sorted input and
   the order are read and written in sequence, a bounded batch of grams at a time.

Grams with very many different stretches, or with very many places of them (equal stretches in one
document, such as padding), go to no single task: the windows of their different stretches are
aggregated by hash with Spark's partial aggregation and joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import runs, slices
from strata.session import materialize

GRAM = 20
BUFFER = 1 << 20  # bytes of text that are hashed together
FLUSH = 1_000_000  # stretches that a task holds before it sends them
LOCAL_STRETCHES = 64  # different stretches of a gram that a task sends to the gram's shard
SHARD_STRETCHES = 2048  # and that a shard resolves as strings
LOCAL_ROWS = 512  # places of a gram's stretches that a task sends to the gram's shard
SHARD_ROWS = 8192  # and that a shard resolves as strings
ROUND_WINDOWS = 200_000  # windows in one construction
MULTIPLIER = np.uint64(0x9FB21C651E98DF25)
INVERSE = np.uint64(pow(0x9FB21C651E98DF25, -1, 1 << 64))
BYTE_VALUES = np.random.default_rng(50).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MARKED, COLD, HOT = 0, 1, 2
PLACED = "doc bigint, tag bigint, start int, stop int"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Hashes:
    """Hashes of all substrings of a buffer, from sums over its prefixes (modulo 2 ** 64)."""

    def __init__(self, data: np.ndarray):
        powers = np.full(len(data) + 1, MULTIPLIER)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        back = np.full(len(data) + 1, INVERSE)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * powers[:-1], out=self.sums[1:])
        self.back = back

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[stop] - self.sums[start]) * self.back[start])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return _mixed((self.sums[length:] - self.sums[:n]) * self.back[:n])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - width + size], values[width - size :]) if width > size else values


def stretches(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text, gram, content, start, windows) of all stretches of texts at least ``length`` long.

    ``gram`` is the least gram hash of the stretch's windows, ``content`` the hash of its bytes,
    ``windows`` the number of window starts. Texts are hashed in one buffer; windows that cross
    from one to the next are left out. Stretches are at most as long as two windows.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes) - sizes
    hashes = Hashes(data)
    grams = min(GRAM, length)
    least = sliding_least(hashes.all(grams), length - grams + 1)
    text = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    inside = np.arange(len(least)) + length <= (begin + sizes)[text]
    change = np.ones(len(least), bool)
    change[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, len(least)))
    keep = inside[first]
    first, count = first[keep], count[keep]
    if len(count) and count.max() > length:  # a gram that repeats at once: cut its long run
        pieces = -(-count // length)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(first, pieces) + nth * length
        count = np.minimum(np.repeat(count, pieces) - nth * length, length)
    content = hashes.of(first, first + count + length - 1)
    owner = text[first]
    return owner, least[first], content, (first - begin[owner]).astype(np.int32), count.astype(np.uint16)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns one after the other, in the narrowest type; ids relative to the least."""
    out = []
    for column in columns:
        base = 0
        if column.dtype.kind == "i" and len(column):
            base = int(column.min())
            column = (column - base).astype(np.uint64)
        wide = int(column.max()).bit_length() if len(column) else 0
        kind = "u1" if wide <= 8 else "u2" if wide <= 16 else "u4" if wide <= 32 else "u8"
        head = np.array([base, int(kind[1]), len(column)], "<i8").tobytes()
        out.append(head + column.astype("<" + kind).tobytes())
    return b"".join(out)


def _unpack(packed: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(packed):
        base, width, n = np.frombuffer(packed, "<i8", 3, at).tolist()
        column = np.frombuffer(packed, f"<u{width}", n, at + 24)
        at += 24 + n * width
        out.append(column.astype(np.int64) + base if base else column)
    return out


def _sorted_groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys (the first counts most) and where a new group begins in it."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    for key in keys:
        own = key[order]
        new[1:] &= own[1:] == own[:-1]
    new[1:] = ~new[1:]
    return order, new


def _spread(per_group: np.ndarray, new: np.ndarray) -> np.ndarray:
    return per_group[np.cumsum(new) - 1]


def _flush(held: list[tuple[np.ndarray, ...]], shards: int) -> Iterator[tuple[int, bytes]]:
    """Payloads (shard, bytes) of a task's stretches.

    Stretches with an equal one in a smaller document of the same task are marked here; grams with
    too many different stretches or places are sent on as hot, with one row to tell their shard.
    """
    doc, tag, gram, content, start, count = (np.concatenate(c) for c in zip(*held, strict=True))
    order, new = _sorted_groups(gram, content, doc)
    doc, tag, gram, content, start, count = (c[order] for c in (doc, tag, gram, content, start, count))
    same = np.zeros(len(doc), bool)
    same[1:] = (gram[1:] == gram[:-1]) & (content[1:] == content[:-1])
    head = np.flatnonzero(~same)
    least = doc[head][np.cumsum(~same) - 1]
    done = doc > least
    gram_new = np.ones(len(doc), bool)
    gram_new[1:] = gram[1:] != gram[:-1]
    at = np.flatnonzero(gram_new)
    different = np.add.reduceat((~same).astype(np.int64), at)
    rows = np.add.reduceat((~done).astype(np.int64), at)
    crowded = _spread((different > LOCAL_STRETCHES) | (rows > LOCAL_ROWS), gram_new)
    state = np.where(done, MARKED, np.where(crowded, HOT, COLD)).astype(np.uint8)
    send = (state == COLD) | (crowded & gram_new)
    shard = (gram % np.uint64(shards)).astype(np.int64)
    other = np.where(send, -1, (doc % shards + shards) % shards)
    for rows, where, asks in ((np.flatnonzero(send), shard, 1), (np.flatnonzero(other >= 0), other, 0)):
        if not len(rows):
            continue
        rows = rows[np.argsort(where[rows], kind="stable")]
        cuts = np.flatnonzero(np.diff(where[rows], prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], len(rows)), strict=True):
            own = rows[a:b]
            columns = [doc[own], tag[own], start[own].astype(np.uint32), count[own], state[own], gram[own]]
            if asks:
                columns.append(content[own])
            yield int(where[own[0]]), _pack(*columns)
    # A crowded gram's first row serves only to tell the shard; the row itself goes on as well.
    rows = np.flatnonzero(crowded & gram_new)
    if len(rows):
        columns = [doc[rows], tag[rows], start[rows].astype(np.uint32), count[rows], state[rows], gram[rows]]
        yield int(shard[rows[0]]), _pack(*columns)


def _shard(payloads: list[bytes]) -> tuple[np.ndarray, ...]:
    """(doc, tag, start, count, state, gram) of the stretches of one shard that need anything done."""
    asked, passed = [], []
    for payload in payloads:
        columns = _unpack(payload)
        columns[0], columns[1] = columns[0].astype(np.int64), columns[1].astype(np.int64)
        columns[5] = columns[5].astype(np.uint64)
        (asked if len(columns) == 7 else passed).append(columns)
    out = []
    if passed:
        out.append([np.concatenate(c) for c in zip(*passed, strict=True)])
    if asked:
        doc, tag, start, count, state, gram, content = (np.concatenate(c) for c in zip(*asked, strict=True))
        content = content.astype(np.uint64)
        order, _ = _sorted_groups(gram, content, doc)
        doc, tag, start, count, state, gram, content = (
            c[order] for c in (doc, tag, start, count, state, gram, content)
        )
        new = np.ones(len(doc), bool)
        new[1:] = gram[1:] != gram[:-1]
        text = new.copy()
        text[1:] |= content[1:] != content[:-1]
        at = np.flatnonzero(new)
        shared = _spread(np.minimum.reduceat(doc, at) < np.maximum.reduceat(doc, at), new)
        told = _spread(np.maximum.reduceat((state != COLD).astype(np.uint8), at) > 0, new)
        different = _spread(np.add.reduceat(text.astype(np.int64), at), new)
        first = _spread(doc[text], text)
        own = state == COLD  # the rest only tells that the gram is crowded elsewhere
        rows = _spread(np.add.reduceat((doc == first).astype(np.int64), at), new)
        kind = np.where(
            own & (doc > first), MARKED,
            np.where(told | (different > SHARD_STRETCHES) | (rows > SHARD_ROWS), HOT, COLD),
        ).astype(np.uint8)
        need = own & ((kind == MARKED) | told | (shared & (different > 1)))
        out.append([c[need] for c in (doc, tag, start, count, kind, gram)])
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else ()


def column_order(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of equally long strings and which of them equal the one before.

    One symbol of every string is inserted per round, from the last to the first. The order after
    a round is that of the strings' ends so far, stably dealt by the new symbol; neighbours keep
    their common prefix if their symbols and their former classes agree.
    """
    m, length = windows.shape
    order = np.arange(m)
    group = np.zeros(m, np.int64)  # class of each string's end so far
    equal = np.ones(m, bool)
    for column in range(length - 1, -1, -1):
        symbols = np.ascontiguousarray(windows[:, column])
        order = order[np.argsort(symbols[order], kind="stable")]
        by_order, classes = symbols[order], group[order]
        equal[1:] = (by_order[1:] == by_order[:-1]) & (classes[1:] == classes[:-1])
        equal[:1] = False
        group[order] = np.cumsum(~equal)
    return order, equal


def _merged(doc, tag, start, length) -> tuple[np.ndarray, ...]:
    """Marks (doc, tag, start, stop) of window starts, neighbouring ones together."""
    order = np.lexsort((start, tag, doc))
    doc, tag, start = doc[order], tag[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc))[: len(first)] - 1
    return doc[first], tag[first], start[first], start[last] + length


def _batch(columns: tuple, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _grouped(keyed: DataFrame, value: str) -> DataFrame:
    return keyed.groupBy("doc", "tag").agg(F.collect_list(value).alias("found"))


def repeated_spans(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """(doc, tag, found): an array of byte ranges (start, stop) to remove, for documents with any.

    ``tag`` is 0, or a hash of the text where several rows have the id.
    """
    spark = df.sparkSession
    shards = 4 * max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = tagged(df, key, text).where(F.col("doc").isNotNull() & (F.octet_length("text") >= length))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def sent():
            for shard, payload in _flush(held, shards):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int32()), pa.array([payload], pa.binary())], names=["shard", "payload"]
                )

        for batch in batches:
            for part in slices(batch, BUFFER):
                doc, tag = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "tag"))
                raw = [t.encode() for t in part.column("text").to_pylist()]
                owner, gram, content, start, count = stretches(raw, length)
                held.append((doc[owner], tag[owner], gram, content, start, count))
                rows += len(owner)
                if rows >= FLUSH:
                    yield from sent()
                    held, rows = [], 0
        if rows:
            yield from sent()

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["shard"]):
            found = _shard([p.as_py() for p in group.column("payload")])
            if found:
                doc, tag, start, count, state, gram = found
                stop = start.astype(np.int32) + count.astype(np.int32) + length - 1
                where = np.where(state == MARKED, 0, gram.astype(np.uint64)).astype(np.uint64)
                for a in range(0, len(doc), 50_000):
                    b = slice(a, a + 50_000)
                    yield _batch(
                        (doc[b], tag[b], start[b].astype(np.int32), stop[b], state[b].astype(np.int32), where[b].view(np.int64)),
                        ["doc", "tag", "start", "stop", "state", "gram"],
                    )

    met = materialize(
        docs.mapInArrow(scan, "shard int, payload binary")
        .repartition("shard")
        .sortWithinPartitions("shard")
        .mapInArrow(resolve, f"{PLACED}, state int, gram bigint")
    )
    open_ = met.where(F.col("state") != MARKED)
    wanted = _grouped(
        open_.withColumn("one", F.struct("start", "stop", "state", "gram")), "one"
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc, tag, t, found in zip(*(part.column(c).to_pylist() for c in ("doc", "tag", "text", "found")), strict=True):
                    data = t.encode()
                    rows += [(f["gram"], f["state"], doc, tag, f["start"], data[f["start"] : f["stop"]]) for f in found]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)],
                    names=["gram", "state", "doc", "tag", "start", "string"],
                )

    strings = materialize(
        docs.join(wanted, ["doc", "tag"]).mapInArrow(
            cut, "gram bigint, state int, doc bigint, tag bigint, start int, string binary"
        )
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for group in runs(batches, ["gram"]):
            held.append(group)
            n += group.column("string").nbytes - 42 * group.num_rows
            if n >= ROUND_WINDOWS:
                yield from _compared(pa.concat_batches(held), length)
                held, n = [], 0
        if held:
            yield from _compared(pa.concat_batches(held), length)

    cold = (
        strings.where(F.col("state") == COLD)
        .repartition("gram")
        .sortWithinPartitions("gram")
        .mapInArrow(compare, PLACED)
    )
    hot = strings.where(F.col("state") == HOT)
    marks = met.where(F.col("state") == MARKED).select("doc", "tag", "start", "stop").union(cold)
    if not hot.isEmpty():
        marks = marks.union(_hot_marks(hot, length))
    return _grouped(marks.withColumn("span", F.struct("start", "stop")), "span")


def _compared(batch: pa.RecordBatch, length: int) -> Iterator[pa.RecordBatch]:
    """Marks of the windows of a batch's strings that equal one of a smaller document."""
    doc, tag, start = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "tag", "start"))
    strings = batch.column("string").to_pylist()
    data = np.frombuffer(b"".join(strings), np.uint8)
    sizes = np.array([len(s) for s in strings])
    count = sizes - length + 1
    owner = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    windows = sliding_window_view(data, length)[(np.cumsum(sizes) - sizes)[owner] + nth]
    order, equal = column_order(windows)
    docs = doc[owner[order]]
    at = np.flatnonzero(~equal)
    least = _spread(np.minimum.reduceat(docs, at), ~equal)
    hit = order[docs > least]
    if len(hit):
        own = owner[hit]
        d, t, a, b = _merged(doc[own], tag[own], start[own] + nth[hit], length)
        yield _batch((d, t, a.astype(np.int32), b.astype(np.int32)), ["doc", "tag", "start", "stop"])


def _hot_marks(hot: DataFrame, length: int) -> DataFrame:
    """Marks of the windows of crowded grams: least document per window, joined back.

    Only different strings are cut into windows, however often they occur; the windows with a
    smaller document come back as one array a string, and neighbours among them as one mark.
    """
    name = {"s": F.xxhash64("string"), "t": F.xxhash64(F.lit(1), "string")}
    windows = hot.groupBy("string").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).withColumns(name).select(
        "s", "t", "low", "high", "string",
        F.explode(F.sequence(F.lit(0), F.octet_length("string") - length)).alias("nth"),
    ).withColumn("window", F.expr(f"substring(string, nth + 1, {length})")).select(
        "s", "t", "low", "high", "nth", F.xxhash64("window").alias("h"), F.xxhash64(F.lit(1), "window").alias("g")
    )
    first = (
        windows.groupBy("h", "g").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .where("low < high").select("h", "g", "low")
    )
    shared = (
        windows.drop("low", "high").join(first, ["h", "g"])
        .groupBy("s", "t").agg(F.collect_list(F.struct("nth", "low")).alias("shared"))
    )
    places = hot.withColumns(name).select("doc", "tag", "start", "s", "t").join(shared, ["s", "t"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = part.column("shared")
                nth, low = (c.to_numpy(zero_copy_only=False) for c in found.flatten().flatten())
                count = found.value_lengths().to_numpy(zero_copy_only=False)
                doc, tag, start = (
                    np.repeat(part.column(c).to_numpy(zero_copy_only=False), count) for c in ("doc", "tag", "start")
                )
                hit = doc > low
                if hit.any():
                    d, t, a, b = _merged(doc[hit], tag[hit], start[hit] + nth[hit], length)
                    yield _batch((d, t, a.astype(np.int32), b.astype(np.int32)), ["doc", "tag", "start", "stop"])

    return places.select("doc", "tag", "start", "shared").mapInArrow(mark, PLACED)


def tagged(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, tag, text), with a tag other than 0 only where an id has several rows."""
    rows = df.select(F.col(key).cast("bigint").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    repeated = rows.where("doc is not null").groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc")
    if repeated.isEmpty():
        return rows.select("doc", F.lit(0).cast("bigint").alias("tag"), "text")
    several = repeated.withColumn("several", F.lit(True))
    tag = F.when(F.col("several"), F.xxhash64("text")).otherwise(F.lit(0))
    return rows.join(several, "doc", "left").select("doc", tag.cast("bigint").alias("tag"), "text")


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept) for every row; ``kept`` are the remaining bytes.

    A byte is removed if a string of ``length`` bytes that covers it also starts in a row with a
    smaller id, judged on the texts as they came in. Rows with the same id do not remove from each
    other; rows without an id remove nothing and lose nothing. Null texts count as empty, and
    texts shorter than ``length`` stay whole. An empty table gives an empty result.
    """
    rows = tagged(df, key, text)
    joined = rows.join(repeated_spans(df, key, text, length), ["doc", "tag"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = []
                for doc, t, found in zip(*(part.column(c).to_pylist() for c in ("doc", "text", "found")), strict=True):
                    data = t.encode()
                    pieces, past, removed, spans = [], 0, 0, 0
                    reach = -1
                    for a, b in sorted((f["start"], f["stop"]) for f in found or ()):
                        if a > reach:
                            pieces.append(data[past:a])
                            spans += 1
                            reach = a
                        if b > reach:
                            removed += b - reach
                            reach = b
                        past = reach
                    out.append((doc, len(data), removed, spans, b"".join(pieces) + data[past:]))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)],
                    names=[key, "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return joined.mapInArrow(run, f"`{key}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
