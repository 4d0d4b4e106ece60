"""Near-duplicate lines: an exact set-similarity join over the lines' word sets.

A line's tokens are ordered by rarity (any one order of all tokens keeps the join exact; rarity
makes it cheap). Two sets of ``n`` and ``m`` tokens with Jaccard similarity of at least 0.75 share
one of the first ``n - ceil(0.75 n) + 1`` tokens of the longer and the first ``m - ceil(6/7 m) + 1``
of the shorter; the places of that token and the lengths bound the overlap further. What is left
is verified on the whole sets. A line goes if an earlier line, in order of (doc_id, line), is
similar to it.

Rarity comes from counts in a fixed number of hashed buckets (``2**COUNT_BITS``), built from the
whole corpus: a bucket's count is never less than a token's, so a token alone in its bucket has no
partner and is not listed.

Equal sets form one class, so a very common line is one entry. A class carries 128 bits, one set by
each of its tokens; a bit that only one of two sets has is a token that only this one has, which
rules out nearly all pairs before they make a row. The prefix tokens are shuffled to their lists
in ``SLICES`` turns, each of which gives its shuffle files back before the next; what a task has for
another travels in packs of many entries, a row each. A list is read in
order of size, so that a class meets only those whose length fits. Tokens whose bucket holds more
than ``DEALT`` words are wide: their lists are dealt over parts.

A list of up to ``SHORT`` classes is joined with itself. In a longer one each member first meets
``FEW`` others that the filters allow, so groups of similar lines make a few rows for each member; a
class needs only one similar earlier one to go. Those still without one, of which pairs were left
out, then meet all earlier members, with the work of a list dealt over as many tasks as it needs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .listjoin import PAIRS, WORK, alone, runs, whole_lists, windows
from .scratch import Scratch
from .textkernel import BYTE_KEY, GAP, LOWER, find_words, hash_spans, mix64, text_blocks

SIMILAR, OF = 75, 100
COUNT_BITS, CHUNK = 20, 1 << 13
#: Lists up to this length are joined with themselves at once; in a longer one each member meets FEW others first.
SHORT, FEW = 512, 16
#: Turns in which the lists are made.
SLICES = 4
#: Occurrences of a token for each task that its list is dealt over.
DEALT = 1 << 15
#: Entries of a task that makes the pairs of short lists, about.
ENTRIES = 1 << 19
#: Entries that a task packs in one go.
PACKED = 1 << 18
#: Digests that repeat, which are broadcast if there are no more of them; their number is counted first.
SENT = 500_000
#: Lines that are read anew; if there are no more of them, their documents' ids are broadcast and other texts aren't read.
READ = 50_000
#: Bits of the maps of the texts and lines that are read anew.
MAP_BITS = 24

_LINE = "doc_id long, line_no int, d1 long, d2 long, n int, s1 long, s2 long, skip int, tokens binary, wide binary"
_BITS = ("s1", "s2")


def _line_words(data: np.ndarray, offs: np.ndarray, wanted=None):
    """(hash of each word, its line, row of each line, line number within the row, byte start and end of each line).

    Lines are the pieces between ``\\n``; a row without text has none. Given ``wanted``, which tells from
    (row, number) the lines whose words matter, the other lines' words are left out.
    """
    lower = LOWER[data]
    breaks = np.flatnonzero(data == 10)
    full = offs[1:] > offs[:-1]
    # A break that ends a row starts an empty last line of that row, at the next row's first byte.
    row = np.searchsorted(offs[1:], np.concatenate([offs[:-1][full], breaks]), "right")
    order = np.argsort(np.concatenate([offs[:-1][full], breaks + 0.5]), kind="stable")
    begin, row = np.concatenate([offs[:-1][full], breaks + 1])[order], row[order]
    end = np.empty_like(begin)
    end[:-1] = begin[1:] - 1
    if len(end):
        last = np.append(row[1:] != row[:-1], True)
        end[last] = offs[1:][row[last]]
    number = np.arange(len(row)) - np.searchsorted(row, row)
    starts, ends, _ = find_words(lower, offs)
    held = np.flatnonzero(end > begin)
    first = np.searchsorted(starts, begin[held])
    line = np.repeat(held, np.diff(np.append(first, len(starts))))
    if wanted is not None:
        keep = wanted(row, number)[line]
        starts, ends, line = starts[keep], ends[keep], line[keep]
    return hash_spans(lower, starts, ends), line, row, number, begin, end


def _order(words: np.ndarray, line: np.ndarray, n_lines: int, rank: np.ndarray) -> np.ndarray:
    """The order by (line, rank, hash): one key holds all of it but some lower bits of the hash."""
    low = max(n_lines, 1).bit_length() + 8
    key = (line.astype(np.uint64) << np.uint64(64 - low + 8)) | (rank.astype(np.uint64) << np.uint64(64 - low)) | (words >> np.uint64(low))
    order = np.argsort(key)
    key = key[order]
    same = np.flatnonzero(key[1:] == key[:-1])
    if (words[order[same]] != words[order[same + 1]]).any():  # different words that only those bits tell apart
        return np.lexsort((words, rank, line))
    return order


def _sets(words: np.ndarray, line: np.ndarray, n_lines: int, rank: np.ndarray):
    """Distinct tokens of each line in order of (rank, hash): (hash, line, rank, place, size of each line, two hashes of each set)."""
    order = _order(words, line, n_lines, rank)
    words, line, rank = words[order], line[order], rank[order]
    first = np.ones(len(words), bool)
    first[1:] = (words[1:] != words[:-1]) | (line[1:] != line[:-1])
    words, line, rank = words[first], line[first], rank[first]
    size = np.bincount(line, minlength=n_lines)
    begin = np.cumsum(size) - size
    place = np.arange(len(words)) - begin[line]
    d1, d2 = np.zeros(n_lines, np.uint64), np.zeros(n_lines, np.uint64)
    held = np.flatnonzero(size)
    if len(held):
        d1[held] = np.add.reduceat(mix64(words + np.uint64(1)), begin[held])
        d2[held] = np.add.reduceat(mix64(words ^ BYTE_KEY[7]), begin[held])
    return words, line, rank, place, size, mix64(d1 + size.astype(np.uint64)), d2


def _buckets(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - COUNT_BITS)).astype(np.int32)


def _bucket_counts(batches):
    """(chunk, counts): occurrences of words in each of the buckets, packed by chunks, once for each partition."""
    total = np.zeros(1 << COUNT_BITS, np.int64)
    for batch in batches:
        for _, _, data, offs in text_blocks(batch.column(0)):
            lower = LOWER[data]
            starts, ends, _ = find_words(lower, offs)
            np.add.at(total, _buckets(hash_spans(lower, starts, ends)), 1)
    yield from _packed({k: x for k, x in enumerate(total.reshape(-1, CHUNK)) if x.any()})


def _packed(chunks: dict[int, np.ndarray]):
    if chunks:
        yield pa.RecordBatch.from_arrays([pa.array(list(chunks), pa.int32()), pa.array([x.tobytes() for x in chunks.values()], pa.binary())], ["chunk", "counts"])


def _summed_counts(batches):
    """Sums of the counts of each chunk; there are no more chunks than ``2**COUNT_BITS / CHUNK``."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, x in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = np.frombuffer(x.as_buffer(), np.int64)
            total[k] = total[k] + x if k in total else x
    yield from _packed(total)


def rarity_table(docs: DataFrame) -> bytes:
    """Log counts by bucket, one byte each: 0 for one occurrence or none."""
    kind = "chunk int, counts binary"
    found = docs.select("text").mapInArrow(_bucket_counts, kind).repartition("chunk").mapInArrow(_summed_counts, kind)
    rank = np.zeros((1 << COUNT_BITS) // CHUNK * CHUNK, np.uint8).reshape(-1, CHUNK)
    for k, x in found.toLocalIterator():
        rank[k] = np.floor(np.log2(np.maximum(np.frombuffer(x, np.int64), 1)) * 4)
    return rank.tobytes()


def _reader(shared):
    """Lines with their digests, bits and listed tokens, given the broadcast rarity table.

    ``skip`` tokens of the prefix, the first ones, are alone in their buckets; ``tokens`` follow, and
    then the ``wide`` ones, whose buckets hold so many words that their lists are dealt over parts. Both
    are 64-bit numbers end to end: a token's hash, and behind that of a wide one its part.
    """

    def lines(batches):
        rank_of = np.frombuffer(shared.value, np.uint8)
        parts_of = np.maximum(2.0 ** (np.arange(256) / 4) / DEALT, 1).astype(np.uint64)
        signed = lambda x: pa.array(x.view(np.int64))
        whole = lambda x: pa.array(x.astype(np.int32))
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, data, offs in text_blocks(batch.column(1)):
                words, line, row, number, _, _ = _line_words(data, offs)
                words, line, rank, place, size, d1, d2 = _sets(words, line, len(row), rank_of[_buckets(words)])
                held = np.flatnonzero(size)
                prefix = place <= (size - -(-size * SIMILAR // OF))[line]
                skip = np.bincount(line, prefix & (rank == 0), minlength=len(row))
                parts = parts_of[rank]
                lists = []
                for keep in (prefix & (rank > 0) & (parts == 1), prefix & (parts > 1)):
                    values = words[keep]
                    cut = np.append(np.searchsorted(line[keep], held), len(values))
                    if lists:
                        values = np.stack([values, d1[line[keep]] % parts[keep]], axis=1)
                    cells = [None, pa.py_buffer((cut * values.strides[0]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))]
                    lists.append(pa.Array.from_buffers(pa.binary(), len(held), cells))
                bit = np.uint64(1) << (words & np.uint64(63))
                half = (words >> np.uint64(6)) & np.uint64(1) > 0
                begin = np.searchsorted(line, held)
                sig = [np.bitwise_or.reduceat(np.where(half == h, bit, np.uint64(0)), begin) if len(held) else bit[:0] for h in (False, True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i + row[held]]), whole(number[held]), signed(d1[held]), signed(d2[held]), whole(size[held]), signed(sig[0]), signed(sig[1]), whole(skip[held]), *lists],
                    ["doc_id", "line_no", "d1", "d2", "n", "s1", "s2", "skip", "tokens", "wide"],
                )

    return lines


def _numbers(cells: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit numbers of binary cells as rows of ``width``, and how many rows each cell has."""
    offs = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1] if len(cells) else np.zeros(1, np.int32)
    n = int(offs[-1] - offs[0]) // 8
    data = np.frombuffer(cells.buffers()[2], np.int64, n, int(offs[0])) if n else np.zeros(0, np.int64)
    return data.reshape(-1, width), np.diff(offs) // (8 * width)


def _listed(batch: pa.RecordBatch, wide: bool, keep=None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The entries of the lists of wide or of other tokens: the row of each, and (v, part, place) by name; only those whose v ``keep`` takes."""
    skip = batch.column("skip").to_numpy().astype(np.int64)
    numbers, n = _numbers(batch.column("tokens"), 1)
    if wide:
        skip = skip + n
        numbers, n = _numbers(batch.column("wide"), 2)
    row = np.repeat(np.arange(len(n)), n)
    out = {"v": numbers[:, 0], "part": numbers[:, 1] + 1 if wide else np.zeros(len(row), np.int64), "place": np.arange(len(row)) + np.repeat(skip - (np.cumsum(n) - n), n)}
    if keep is not None:
        ok = keep(out["v"])
        row, out = row[ok], {k: x[ok] for k, x in out.items()}
    return row, out


#: The numbers of an entry, in the order of a pack.
_PACK = ("v", "part", "cid", "np", "s1", "s2")


def _packer(turn: int, tasks: int):
    """Classes to (task, pack): the entries of a turn for each of ``tasks`` tasks; a list or part of one goes to one task."""

    def packs(held: list[np.ndarray]):
        rows = np.concatenate(held, axis=1)
        task = ((mix64(rows[0].view(np.uint64) + rows[1].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(tasks)).astype(np.int32)
        order = np.argsort(task, kind="stable")
        task, rows = task[order], rows[:, order]
        cut = np.append(np.flatnonzero(np.diff(task, prepend=-1)), len(task))
        cells = [rows[:, a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(task[cut[:-1]], pa.int32()), pa.array(cells, pa.binary())], ["task", "pack"])

    def packed(batches):
        held, n = [], 0
        for batch in batches:
            row, rows = _listed(batch, turn == SLICES, (lambda v: v & (SLICES - 1) == turn) if turn < SLICES else None)
            if not len(row):
                continue
            own = {k: batch.column(k).to_numpy() for k in ("cid", "n", "s1", "s2")}
            rows |= {"np": (own["n"].astype(np.int64)[row] << 32) + rows["place"]} | {k: own[k][row] for k in ("cid", "s1", "s2")}
            held.append(np.stack([rows[k] for k in _PACK]))
            n += len(row)
            if n >= PACKED:
                yield from packs(held)
                held, n = [], 0
        if held:
            yield from packs(held)

    return packed


def _unpacked(batches) -> dict[str, np.ndarray]:
    """All entries of packs as arrays by name; none if there are no packs."""
    held = [np.frombuffer(x.as_buffer(), np.int64).reshape(len(_PACK), -1) for batch in batches for x in batch.column(0)]
    return {k: np.concatenate([x[i] for x in held]).view(np.uint64 if k in _BITS else np.int64) for i, k in enumerate(_PACK)} if held else {}


def _fits(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether members ``i`` and ``j`` of one list can be similar: by length, by place and by the bits that one has alone."""
    n, m, p, q = rows["n"][i], rows["n"][j], rows["place"][i], rows["place"][j]
    short = np.minimum(n, m)
    least = -(-(n + m) * SIMILAR // (OF + SIMILAR))
    place = np.where(n < m, p, np.where(m < n, q, np.minimum(p, q)))
    out = (short * OF >= np.maximum(n, m) * SIMILAR) & (place <= short - -(-short * 2 * SIMILAR // (OF + SIMILAR))) & (np.minimum(n - p, m - q) >= least)
    at = np.flatnonzero(out)
    i, j, n, m, least = i[at], j[at], n[at], m[at], least[at]
    out[at] = (alone(rows, _BITS, i, j) <= n - least) & (alone(rows, _BITS, j, i) <= m - least)
    return out


def _pairs(a, b, v=(), cid=()) -> pa.RecordBatch:
    """Pairs (a, b), and behind them a row for each of (v, cid)."""
    n, k = len(a), len(v)
    rows = [pa.concat_arrays([pa.array(x, pa.int64()), pa.nulls(k, pa.int64())]) for x in (a, b)]
    rows += [pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(x, pa.int64())]) for x in (v, cid)]
    return pa.RecordBatch.from_arrays(rows, ["a", "b", "v", "cid"])


def _within_lists(batches):
    """Packs of entries (v, part, cid, np, s1, s2) of whole lists or parts to (a, b, v, cid): pairs of class ids, and the members (v, cid) that are not done with them.

    A partition is held whole: no list or part of it has more than ``DEALT`` entries, since its bucket
    has no more words. In a long list each member meets the first FEW of those that fit; both ends of
    a pair that is left out are not done, nor is any member of a list that is dealt over parts.
    """
    rows = _unpacked(batches)
    if not rows:
        return
    rows["n"], rows["place"] = rows["np"] >> 32, rows["np"] & 0xFFFFFFFF
    order = np.lexsort((rows["part"], rows["v"])) if rows["part"].any() else np.argsort(rows["v"])
    group = runs(rows["v"][order], rows["part"][order])
    size = np.bincount(group)
    some = (size > 1)[group] | (rows["part"][order] > 0)
    order, group = order[some], group[some]
    inner = np.lexsort((rows["n"][order], group))
    order, group = order[inner], group[inner]
    rows = {k: rows[k][order] for k in ("v", "part", "cid", "n", "place", *_BITS)}
    long = (size > SHORT)[group]
    cut = rows["part"] > 0
    left = []
    for i, j in windows(group, rows["n"], (OF, SIMILAR)):
        ok = _fits(rows, i, j)
        i, j = i[ok], j[ok]
        few = ~long[i]
        yield _pairs(rows["cid"][i[few]], rows["cid"][j[few]])
        if not few.all():
            left.append(np.stack([i[~few], j[~few]]))
        if left and sum(x.shape[1] for x in left) > PAIRS:
            left = [_first_few(np.concatenate(left, axis=1), cut)]
    if left:
        i, j = _first_few(np.concatenate(left, axis=1), cut)
        yield _pairs(rows["cid"][i], rows["cid"][j])
    yield _pairs(rows["cid"][:0], rows["cid"][:0], rows["v"][cut], rows["cid"][cut])


def _first_few(pairs: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The first FEW pairs of each first end; ``cut`` gets both ends of the others."""
    pairs = pairs[:, np.lexsort((pairs[1], pairs[0]))]
    ok = np.arange(pairs.shape[1]) - np.searchsorted(pairs[0], pairs[0]) < FEW
    cut[pairs[:, ~ok].ravel()] = True
    return pairs[:, ok]


def _earlier(batches):
    """Entries in order of (v, block, n) to pairs (a, b): ``open`` members with all that may be earlier."""
    for rows in whole_lists(batches, ("v", "block"), _BITS):
        for i, j in windows(runs(rows["v"], rows["block"]), rows["n"], (OF, SIMILAR)):
            for x, y in ((i, j), (j, i)):
                ok = rows["open"][x] & (rows["doc_id"][y] <= rows["doc_id"][x])
                x, y = x[ok], y[ok]
                ok = _fits(rows, x, y)
                yield pa.RecordBatch.from_arrays([pa.array(rows["cid"][x[ok]]), pa.array(rows["cid"][y[ok]])], ["a", "b"])


def _map_places(doc_id: np.ndarray, line_no: np.ndarray | None = None) -> np.ndarray:
    """Places in a bitmap of MAP_BITS bits: of texts, or of their lines."""
    x = mix64(doc_id.astype(np.int64).view(np.uint64) + np.uint64(0x9E37))
    if line_no is not None:
        x = mix64(x ^ (line_no.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return x >> np.uint64(64 - MAP_BITS)


def _map_words(batches):
    """(doc_id, line_no) to (which, w, x): the words of both bitmaps that they set bits of."""
    for batch in batches:
        doc_id, line_no = (batch.column(k).to_numpy() for k in range(2))
        for which, place in enumerate((_map_places(doc_id), _map_places(doc_id, line_no))):
            bit = np.uint64(1) << (place & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), which, np.int32)), pa.array((place >> np.uint64(6)).astype(np.int32)), pa.array(bit.view(np.int64))], ["which", "w", "x"])


def _has(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    return ((bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1)) > 0


def _listed_sets(maps):
    """(doc_id, text) to (doc_id, line_no, d1, tokens) of the lines that the bitmaps have."""

    def sets_of(batches):
        texts, lines = (np.frombuffer(m, np.uint64) for m in maps.value)
        for batch in batches:
            batch = batch.filter(pa.array(_has(texts, _map_places(batch.column(0).to_numpy()))))
            ids = batch.column(0).to_numpy()
            for i, _, data, offs in text_blocks(batch.column(1)):
                words, line, row, number, _, _ = _line_words(data, offs, lambda row, number, i=i: _has(lines, _map_places(ids[i + row], number)))
                words, line, _, _, size, d1, _ = _sets(words, line, len(row), np.zeros(len(words), np.uint8))
                at = np.cumsum(size) - size
                held = np.flatnonzero(size)
                tokens = pa.array([words[a : a + n].tobytes() for a, n in zip(at[held].tolist(), size[held].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(ids[i + row[held]]), pa.array(number[held].astype(np.int32)), pa.array(d1[held].view(np.int64)), tokens], ["doc_id", "line_no", "d1", "tokens"])

    return sets_of


def _verified(batches):
    """(a, b, x, y) to the (a, b) whose whole sets are similar."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(OF * both >= SIMILAR * (len(x) + len(y) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _sets_of(wanted: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(cid, tokens) of the lines ``wanted`` (cid, doc_id, line_no, d1): read anew from the texts, of which only those lines are passed on.

    Bitmaps of a fixed size tell which texts and lines to take; what they let through in vain the join drops.
    """
    found = wanted.select("doc_id", "line_no").mapInArrow(_map_words, "which int, w int, x long").groupBy("which", "w").agg(F.bit_or("x").alias("x")).toArrow()
    maps = []
    for which in range(2):
        own = found.filter(pc.equal(found["which"], which))
        bits = np.zeros(1 << (MAP_BITS - 6), np.uint64)
        bits[own["w"].to_numpy()] = own["x"].to_numpy().view(np.uint64)
        maps.append(bits.tobytes())
    shared = docs.sparkSession.sparkContext.broadcast(maps)
    if wanted.count() <= READ:
        docs = docs.join(F.broadcast(wanted.select("doc_id").distinct()), "doc_id", "left_semi")
    read = docs.mapInArrow(_listed_sets(shared), "doc_id long, line_no int, d1 long, tokens binary")
    key = ["doc_id", "line_no", "d1"]  # rows repeated whole give a line again
    sets = scratch.cut(read.dropDuplicates(key).join(wanted, key).select("cid", "tokens"), "sets")
    shared.destroy()
    return sets


def _prints(batches):
    """(cid, tokens) to (cid, prints): a byte of each token."""
    for batch in batches:
        prints = [np.frombuffer(x.as_buffer(), np.uint64).astype(np.uint8).tobytes() for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary())], ["cid", "prints"])


def _perhaps(batches):
    """(a, b, x, y) to the (a, b) whose prints do not rule out that their sets are similar: no set shares more tokens than prints."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
            both = int(np.minimum(np.bincount(x, minlength=256), np.bincount(y, minlength=256)).sum())
            keep.append(OF * both >= SIMILAR * (len(x) + len(y) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _met(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    return pairs.join(sets.toDF("late", "x"), "late").join(sets.toDF("early", "y"), "early").select("late", "early", "x", "y")


def _likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (late, early) that a byte of each token does not rule out; they are many, so whole sets are not sent with each."""
    return _met(pairs, sets.mapInArrow(_prints, "cid long, prints binary")).mapInArrow(_perhaps, "late long, early long")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The late ones (cid) of ``pairs`` (late, early) whose whole sets are similar."""
    met = _met(pairs, sets)
    return met.mapInArrow(_verified, "late long, early long").select(F.col("late").alias("cid")).distinct()


def _late(pairs: DataFrame, places: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The class ids (cid) that a similar and earlier one of ``pairs`` (a, b) makes go.

    One such is enough: each class is held against the earliest of its candidates first, and only
    those that this doesn't settle against all of them.
    """
    at = places.select("cid", F.struct("doc_id", "line_no", "d1").alias("at"))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    placed = pairs.join(at.toDF("a", "at_a"), "a").join(at.toDF("b", "at_b"), "b")
    later = F.col("at_a") > F.col("at_b")
    ends = [F.when(later, F.col(x)).otherwise(F.col(y)) for x, y in (("a", "b"), ("b", "a"), ("at_b", "at_a"))]
    pairs = scratch.cut(placed.select(ends[0].alias("late"), ends[1].alias("early"), ends[2].alias("at")), "pairs")
    wanted = pairs.select(F.explode(F.array("late", "early")).alias("cid")).distinct().join(places.select("cid", "doc_id", "line_no", "d1"), "cid")
    wanted = scratch.cut(wanted.select("cid", "doc_id", "line_no", "d1"), "wanted")
    sets = _sets_of(wanted, docs, scratch)
    first = pairs.groupBy("late").agg(F.min(F.struct("at", "early")).alias("x")).select("late", F.col("x.early").alias("early"))
    found = scratch.cut(_similar(first, sets), "similar")
    first = first.withColumnRenamed("early", "tried")
    rest = pairs.select("late", "early").join(found.toDF("late"), "late", "left_anti").join(first, "late").filter("early <> tried")
    rest = scratch.cut(rest.select("late", "early"), "rest")
    if not rest.isEmpty():
        likely = scratch.cut(_likely(rest, sets), "likely")
        ends = likely.select(F.explode(F.array("late", "early")).alias("cid")).distinct()
        found = found.union(scratch.cut(_similar(likely, sets.join(ends, "cid", "left_semi")), "similar"))
        scratch.drop(likely)
    scratch.drop(pairs, wanted, sets, rest)
    return found


def _list_map(batches):
    """(v) to (w, x): the words of a bitmap that they set bits of."""
    for batch in batches:
        place = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - MAP_BITS)
        yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (place & np.uint64(63))).view(np.int64))], ["w", "x"])


def _lister(shared):
    """Classes to the entries of all lists that the broadcast bitmap has."""

    def entries(batches):
        bits = np.frombuffer(shared.value, np.uint64)
        for batch in batches:
            for wide in (False, True):
                row, rows = _listed(batch, wide, lambda v: _has(bits, v.view(np.uint64) >> np.uint64(64 - MAP_BITS)))
                own = batch.select(["cid", "n", "s1", "s2", "doc_id"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(rows["v"]), pa.array(rows["place"].astype(np.int32)), *own.columns], ["v", "place", "cid", "n", "s1", "s2", "doc_id"])

    return entries


def _lists(classes: DataFrame, left: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, place, cid, n, s1, s2, doc_id): all entries of the lists that ``left`` (v, cid) names; a bitmap of a fixed size spares most others, and the join the rest."""
    lists = left.select("v").distinct()
    found = lists.mapInArrow(_list_map, "w int, x long").groupBy("w").agg(F.bit_or("x").alias("x")).toArrow()
    bits = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    bits[found["w"].to_numpy()] = found["x"].to_numpy().view(np.uint64)
    shared = classes.sparkSession.sparkContext.broadcast(bits.tobytes())
    entries = classes.select("cid", "n", "s1", "s2", "skip", "tokens", "wide", "doc_id").mapInArrow(_lister(shared), "v long, place int, cid long, n int, s1 long, s2 long, doc_id long")
    listed = scratch.cut(entries.join(lists, "v", "left_semi"), "listed")
    shared.destroy()
    return listed


def _late_among_all(listed: DataFrame, left: DataFrame, places: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The class ids (cid) of the members ``left`` (v, cid) that go, each held against all earlier ones of its lists ``listed``."""
    rows = listed.join(left.withColumn("open", F.lit(True)), ["v", "cid"], "left").withColumn("open", F.col("open").isNotNull())
    # The open members of a list are dealt over blocks, each of which gets all the others.
    work = rows.groupBy("v").agg(F.ceil(F.count("*") * F.count_if("open") / WORK).cast("int").alias("blocks")).filter("blocks > 0")
    rows = rows.join(work, "v").withColumn("own", F.pmod(F.hash("cid"), "blocks")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("open", F.col("open") & (F.col("own") == F.col("block"))).drop("blocks", "own")
    dealt = rows.repartition("v", "block").sortWithinPartitions("v", "block", "n")
    return _late(dealt.mapInArrow(_earlier, "a long, b long"), places, docs, scratch)


def repeated_lines(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, n_tokens, exact, d1) of the lines of ``docs`` (doc_id, text) that repeat an earlier one.

    Lines are split at ``\\n`` and numbered from 0; tokens are the distinct words after lower-casing
    A-Z. A line with a word repeats an earlier line, in order of (doc_id,
    line_no), if their Jaccard similarity is at least 0.75; ``exact`` tells that an earlier line has
    the same set. Null texts have no lines; rows with a null doc_id take no part. Repeated rows (one
    doc_id and text) are treated alike, and a line is never its own repetition; where a doc_id has
    two texts, lines of one number rank by their sets' digests. ``d1`` identifies the line's set.
    Other columns are not read; an empty table gives no rows; long lines and texts are read whole.
    """
    scratch = Scratch(spark, "linedup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    shared = spark.sparkContext.broadcast(rarity_table(docs))
    lines = scratch.cut(docs.mapInArrow(_reader(shared), _LINE), "lines")
    shared.destroy()
    again = lines.groupBy("d1", "d2").agg(F.count("*").alias("k")).filter("k > 1").select("d1", "d2")
    again = scratch.cut(again, "again")
    once = None
    held = ["n", "s1", "s2", "skip", "tokens", "wide"]
    if again.count() <= SENT:  # else all lines are grouped
        once = lines.join(F.broadcast(again), ["d1", "d2"], "left_anti").withColumn("lines", F.lit(1).cast("long"))
        repeated = lines.join(F.broadcast(again), ["d1", "d2"], "left_semi")
    else:
        repeated = lines
    heads = repeated.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "line_no")).alias("at"), F.count("*").alias("lines"), *[F.first(c).alias(c) for c in held])
    heads = heads.select("d1", "d2", "at.doc_id", "at.line_no", "lines", *held)
    heads = heads if once is None else once.select("d1", "d2", "doc_id", "line_no", "lines", *held).union(heads)
    classes = scratch.cut(heads.withColumn("cid", F.monotonically_increasing_id()), "classes")
    # What is needed to the end goes to narrow tables, and the wide ones away as soon as they are read.
    numbered = scratch.cut(lines.select("doc_id", "line_no", "d1", "d2", "n"), "numbered")
    scratch.drop(lines, again)
    places = scratch.cut(classes.select("cid", "doc_id", "line_no", "d1", "d2", "lines"), "places")

    entries, wide = (x // 8 for x in classes.agg(*[F.coalesce(F.sum(F.length(c)), F.lit(0)) for c in ("tokens", "wide")]).first())
    turns = [(k, classes, entries // SLICES) for k in range(SLICES)] + [(SLICES, classes.filter(F.length("wide") > 0), wide // 2)] * (wide > 0)
    found = None
    for turn, rows, n in turns:
        tasks = 1 + n // ENTRIES
        packs = rows.select("cid", "n", "s1", "s2", "skip", "tokens", "wide").mapInArrow(_packer(turn, tasks), "task int, pack binary")
        dealt = packs.repartitionById(tasks, "task").select("pack")
        met = scratch.cut(dealt.mapInArrow(_within_lists, "a long, b long, v long, cid long"), "met")
        found = met if found is None else found.union(met)
    late = _late(found.filter("a IS NOT NULL").select("a", "b"), places, docs, scratch)
    left = scratch.cut(found.filter("v IS NOT NULL").select("v", "cid").join(late, "cid", "left_anti").select("v", "cid"), "left")
    if not left.isEmpty():
        late = late.union(_late_among_all(_lists(classes, left, scratch), left, places, docs, scratch))
    scratch.drop(classes, left)

    # Of the classes only those matter that have several lines or whose line goes.
    verdict = places.join(late.distinct().withColumn("similar", F.lit(True)), "cid", "left").filter("lines > 1 OR similar")
    verdict = verdict.select("d1", "d2", F.col("doc_id").alias("head_doc"), F.col("line_no").alias("head_line"), "similar")
    each = numbered.join(verdict, ["d1", "d2"])
    exact = (F.col("doc_id") != F.col("head_doc")) | (F.col("line_no") != F.col("head_line"))
    return each.filter(exact | F.col("similar")).select("doc_id", "line_no", F.col("n").cast("long").alias("n_tokens"), exact.alias("exact"), "d1").dropDuplicates(["doc_id", "line_no", "d1"])


def _rewritten(names: list[str]):
    """(row, gone) to the columns of ``row``, with the listed lines taken out of the text.

    Yields nothing for a text that had words and has none left.
    """
    blank = GAP[:128]
    where = names.index("text")

    def rewrite(batches):
        for batch in batches:
            columns, gone = batch.column(0).flatten(), batch.column(1)
            hit = np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False))
            if not len(hit):
                yield pa.RecordBatch.from_arrays(columns, names)
                continue
            texts, keep = columns[where].to_pylist(), np.ones(batch.num_rows, bool)
            for i, j, data, offs in text_blocks(columns[where].take(pa.array(hit))):
                words, line, row, number, begin, end = _line_words(data, offs)
                d1 = _sets(words, line, len(row), np.zeros(len(words), np.uint8))[5]
                top = np.searchsorted(row, np.arange(j - i + 1))
                for k in range(i, j):
                    listed = {(x["line_no"], x["d1"]) for x in gone[int(hit[k])].as_py()}
                    own = range(top[k - i], top[k - i + 1])
                    kept = [data[begin[x] : end[x]].tobytes() for x in own if (int(number[x]), int(d1[x].view(np.int64))) not in listed]
                    texts[hit[k]] = b"\n".join(kept).decode()
                    keep[hit[k]] = any(not all(c < 128 and blank[c] for c in x) for x in kept)
            columns[where] = pa.array(texts, columns[where].type)
            if "n_chars" in names:
                at = names.index("n_chars")
                columns[at] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))

    return rewrite


def drop_repeated_lines(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with the lines of ``repeated_lines`` taken out of the texts, and n_chars renewed if there is one.

    A document that loses its last word goes; those without words before, null texts and null ids
    stay as they are. Rows repeated whole are rewritten alike. Other columns, whatever their names
    and nulls, are passed on: a row travels as one struct, so no name can clash.
    """
    gone = repeated_lines(spark, docs).groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "d1")).alias("gone"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    met = rows.join(gone, F.col("row")["doc_id"].cast("long") == F.col("doc_id"), "left").select("row", "gone")
    return met.mapInArrow(_rewritten(docs.columns), docs.schema)
