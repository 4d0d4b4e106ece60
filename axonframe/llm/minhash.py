"""Near-duplicate documents: bottom-k sketches, inverted lists, union-sketch filter, exact Jaccard.

One hash function numbers the word shingles. A document keeps its ``K`` smallest numbers. If two
sets have Jaccard similarity of at least 0.75, their sketches share at least ``_need`` values: a
certainty for sets of up to 108 shingles, else but for about 1e-8 of the pairs that stand exactly
at the threshold (mean 48 of 64, standard deviation 3.5, need 28).

Candidates meet in the inverted list of a value. With a document's values in order of rarity, two
that share ``need`` values share one among the first ``size - need + 1``, so only these are listed;
a document with fewer than ``need`` values that occur elsewhere has no partner and is done.

A list may hold a third of the corpus. Its members first meet only the list's most central member
(a linear number of pairs); connected components of the verified links follow. What can still be
linked stands in lists that span components. There, those members that are not linked to the centre
are compared whole with all the others, in blocks of a few hundred texts whose sets are multiplied as
bit rows; a block pair returns a spanning forest of its links, so a crowd of texts that resemble each
other never makes a row for each two of them. Which members that had no sketch in common with the
centre take part is found before, within the tasks that read a centre's lists in order of size: only
those that sizes and sketch bits allow a link with a member of another component. No link between
components is lost, and none within one is tried in vain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .components import components
from .listjoin import WORK, alone, runs, whole_lists, windows
from .scratch import Scratch
from .textkernel import digest128, long_lists, shingle_sets, text_blocks

#: Values kept of a document, and shared values that any similar pair has at the least.
K, NEED = 64, 28
SIMILAR, OF = 75, 100
#: Sketches hold values with this bit flipped: as signed longs they sort like the unsigned numbers.
TOP = np.uint64(1 << 63)
#: Rows (of a few dozen bytes) of a table that is broadcast at most; its size is counted first.
SENT = 50_000
#: Rows of a block, about, and pairs of blocks that a task compares, about.
BLOCK, TURNS = 256, 64
#: A sketch as bits, each set by the values of one remainder.
_BITS = ("b0", "b1", "b2", "b3")

_SKETCH = "doc_id long, text_key long, n_shingles long, digest binary, sketch array<long>"


def _sketches(batches):
    for batch in batches:
        ids, keys = batch.column(0).cast(pa.int64()), batch.column(2)
        for i, j, data, offs in text_blocks(batch.column(1)):
            sets = list(shingle_sets(data, offs))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(i, j - i),
                    keys.slice(i, j - i),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([digest128(s) for s in sets], pa.binary()),
                    long_lists([s[:K] ^ TOP for s in sets]),
                ],
                ["doc_id", "text_key", "n_shingles", "digest", "sketch"],
            )


def _sketch_bits(batches):
    """(cid, sketch) to (cid, b0, b1, b2, b3)."""
    for batch in batches:
        lists = batch.column(1)
        values, offs = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy()
        row = np.repeat(np.arange(batch.num_rows), np.diff(offs))
        bits = np.zeros((batch.num_rows, len(_BITS)), np.uint64)
        np.bitwise_or.at(bits, (row, ((values >> np.uint64(6)) & np.uint64(3)).astype(np.int64)), np.uint64(1) << (values & np.uint64(63)))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(bits[:, k].copy().view(np.int64)) for k in range(len(_BITS))]], ["cid", *_BITS])


def _apart(batches):
    """Members in order of (c, block, n) to (c, cid): those not near the centre that sizes and sketch bits allow a link with a member of another component."""
    for rows in whole_lists(batches, ("c", "block"), _BITS):
        found = np.zeros(len(rows["c"]), bool)
        for i, j in windows(runs(rows["c"], rows["block"]), rows["n"], (OF, SIMILAR)):
            ok = rows["own"][i] & (rows["comp"][i] != rows["comp"][j]) & ~(rows["near"][i] & rows["near"][j])
            i, j = i[ok], j[ok]
            need = np.maximum(rows["need"][i], rows["need"][j])
            kept = [np.minimum(rows["n"][x], K) for x in (i, j)]
            ok = (alone(rows, _BITS, i, j) <= kept[0] - need) & (alone(rows, _BITS, j, i) <= kept[1] - need)
            found[i[ok]] = found[j[ok]] = True
        held = np.flatnonzero(found & ~rows["near"])
        yield pa.RecordBatch.from_arrays([pa.array(rows["c"][held]), pa.array(rows["cid"][held])], ["c", "cid"])


def _whole_sets(batches):
    """(cid, digest, text) to (cid, shingles): the sets of the texts that have the wanted digest."""
    for batch in batches:
        cids, wanted = batch.column(0), batch.column(1).to_pylist()
        for i, j, data, offs in text_blocks(batch.column(2)):
            sets = list(shingle_sets(data, offs))
            held = [k for k, s in enumerate(sets) if digest128(s) == wanted[i + k]]
            yield pa.RecordBatch.from_arrays([cids.slice(i, j - i).take(pa.array(held, pa.int64())), pa.array([sets[k].tobytes() for k in held], pa.binary())], ["cid", "shingles"])


def _compared(batches):
    """(a, b, x, y) to (a, b, linked): whether the whole sets are similar."""
    for batch in batches:
        linked = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(OF * both >= SIMILAR * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])


def _forest(a, b) -> list[tuple[int, int]]:
    """The edges that first join two trees."""
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((max(x, y), min(x, y)))
    return out


def _crowded(batches):
    """Links (a, b) between components, of the members of two blocks: a spanning forest of them."""
    for batch in batches:
        edges = []
        for xs, ys in zip(batch.column(0), batch.column(1)):
            sides = []
            for z in (xs.values, ys.values):
                sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in z.field("shingles")]
                sides.append((z.field("cid").to_numpy(), z.field("comp").to_numpy(), np.array([len(v) for v in sets]), np.concatenate(sets)))
            (xi, xc, xn, xv), (yi, yc, yn, yv) = sides
            shared = np.intersect1d(xv, yv)
            both = np.zeros((len(xi), len(yi)), np.float32)
            place = lambda v, n, few: (np.repeat(np.arange(len(n)), n), np.searchsorted(few, v).clip(max=len(few) - 1))
            for k in range(0, len(shared), 1 << 13):
                few = shared[k : k + (1 << 13)]
                bits = []
                for v, n in ((xv, xn), (yv, yn)):
                    row, at = place(v, n, few)
                    held = few[at] == v
                    m = np.zeros((len(n), len(few)), np.float32)
                    m[row[held], at[held]] = 1
                    bits.append(m)
                both += bits[0] @ bits[1].T
            hit = ((OF + SIMILAR) * both.astype(np.float64) >= SIMILAR * (xn[:, None] + yn[None, :])) & (xc[:, None] != yc[None, :])
            i, j = np.nonzero(hit)
            edges += _forest(xi[i], yi[j])
        a, b = np.array(edges, np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _need(n, kept):
    """Sketch values that a document of ``n`` shingles shares with any similar one."""
    return F.greatest(F.lit(1), F.least(F.ceil(n * SIMILAR / OF), F.greatest(F.lit(NEED), F.floor(F.lit(K) - n / 3)))).cast("int")


def _sketch_filter(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Drops pairs whose union sketch holds fewer common values than any similar pair has."""
    side = classes.select("cid", "sketch", _need(F.col("n"), K).alias("need"))
    met = pairs.join(side.toDF("a", "sa", "na"), "a").join(side.toDF("b", "sb", "nb"), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    common = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    return met.filter(common >= F.greatest("na", "nb")).select("a", "b")


def _sets_of(wanted: DataFrame, classes: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(cid, shingles) of the classes ``wanted`` (cid): the whole sets of their texts."""
    wanted = scratch.cut(wanted.join(classes.select("cid", "rep_id", "digest"), "cid"), "wanted")
    few = F.broadcast(wanted) if wanted.count() <= SENT else wanted  # else the texts are shuffled
    texts = docs.join(few, docs.doc_id == wanted.rep_id).select("cid", "digest", "text")
    sets = scratch.cut(texts.mapInArrow(_whole_sets, "cid long, shingles binary").dropDuplicates(["cid"]), "sets")
    scratch.drop(wanted)
    return sets


def _compare(pairs: DataFrame, classes: DataFrame, docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(a, b, linked) of the pairs (a, b) of class ids that pass the sketch filter, and the sets (cid, shingles) of the texts involved, compared whole."""
    pairs = scratch.cut(_sketch_filter(pairs, classes), "pairs")
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), classes, docs, scratch)
    met = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    out = scratch.cut(met.mapInArrow(_compared, "a long, b long, linked boolean"), "compared")
    scratch.drop(pairs)
    return out, sets


def _candidates(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, cid, n, need, central): the inverted lists of the rarest shared values.

    ``central`` is the same for all values of a document and grows with the company they keep.
    """
    values = classes.select("cid", F.explode("sketch").alias("v"))
    shared = values.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    docs = values.join(shared, "v").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"), F.sum("df").alias("central"))
    docs = docs.join(classes.select("cid", "n"), "cid").withColumn("need", _need(F.col("n"), K)).filter(F.size("vs") >= F.col("need"))
    lists = docs.select("cid", "n", "need", "central", F.explode(F.slice("vs", F.lit(1), F.size("vs") - F.col("need") + 1)).alias("e"))
    return scratch.cut(lists.select(F.col("e.v").alias("v"), "cid", "n", "need", "central"), "lists")


def _crowd(members: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) among the ``members`` (c, cid, comp, n, linked) of a centre c, but for those that are both linked to it."""
    size = members.groupBy("c").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / (BLOCK * 512))).cast("int").alias("blocks"),
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.bool_and("linked").alias("done"),
    ).filter("lo <> hi AND NOT done").select("c", "blocks")
    members = members.join(size, "c").withColumn("block", F.pmod(F.hash("cid"), "blocks")).join(sets, "cid")
    rows = F.collect_list(F.struct("cid", "comp", "shingles")).alias("rows")
    blocks = scratch.cut(members.groupBy("c", "blocks", "block", "linked").agg(rows), "blocks")
    # The unlinked blocks of a centre are dealt over as many turns as they need; each turn meets all blocks.
    turns = F.ceil(F.col("blocks") * F.col("blocks") / TURNS).cast("int")
    xs = blocks.filter("NOT linked").select("c", F.pmod("block", turns).alias("turn"), F.col("block").alias("xblock"), F.col("rows").alias("xrows"))
    ys = blocks.select("c", F.explode(F.sequence(F.lit(0), turns - 1)).alias("turn"), F.col("block").alias("yblock"), F.col("linked").alias("ylinked"), F.col("rows").alias("yrows"))
    met = xs.join(ys, ["c", "turn"]).filter("ylinked OR yblock >= xblock").select("xrows", "yrows")
    found = scratch.cut(met.mapInArrow(_crowded, "a long, b long"), "crowd")
    scratch.drop(blocks)
    return found


def _far(lists: DataFrame, spans: DataFrame, first: DataFrame, member: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(c, cid, comp, n) of the members of the lists that span components which are not near the centre c, and may be linked with another member.

    Lists with one centre are read as one, so that documents which meet in many of them meet once.
    """
    rows = lists.join(spans, "v").groupBy("c", "cid").agg(F.max("n").alias("n"), F.max("need").alias("need"))
    rows = rows.join(member.toDF("cid", "comp"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    near = first.select(F.col("a").alias("cid"), F.col("b").alias("c"), F.lit(True).alias("near"))
    rows = rows.join(near, ["cid", "c"], "left").withColumn("near", F.col("near").isNotNull() | (F.col("cid") == F.col("c")))
    rows = scratch.cut(rows.select("c", "cid", "comp", "n", "need", "near"), "spread")
    # Each pair is one block's; a block has a share of the shorter members and all the longer ones.
    work = rows.groupBy("c").agg(F.ceil(F.count("*") * F.count("*") / WORK).cast("int").alias("blocks"), F.bool_and("near").alias("done")).filter("NOT done").select("c", "blocks")
    bits = rows.select("cid").distinct().join(classes.select("cid", "sketch"), "cid").mapInArrow(_sketch_bits, "cid long, " + ", ".join(f"{b} long" for b in _BITS))
    dealt = rows.join(work, "c").join(bits, "cid").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("own", F.pmod(F.hash("cid"), "blocks") == F.col("block")).drop("blocks")
    dealt = dealt.repartition("c", "block").sortWithinPartitions("c", "block", "n")
    found = dealt.mapInArrow(_apart, "c long, cid long").distinct()
    return scratch.cut(rows.join(found, ["c", "cid"]).select("c", "cid", "comp", "n"), "far")


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_key) for every row of ``docs`` (doc_id, text).

    Equal shingle sets form a class; links are sought between classes. Null and empty texts have no
    shingles and stand alone. Rows with a null doc_id are never linked: component_id is null and kept
    false. Repeated rows are each returned, with one component; a repeated doc_id with different
    texts follows each text, and ``text_key`` (xxhash64 of the text) tells its rows apart. Ties have
    no part in it: a component is named by its smallest doc_id. An empty table gives no rows; texts
    of any length are read whole; other columns are not read.
    """
    scratch = Scratch(spark, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    rows = scratch.cut(docs.mapInArrow(_sketches, _SKETCH), "sketches")
    firsts = [F.min("doc_id").alias("rep_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")]
    classes = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(*firsts)
    classes = scratch.cut(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    lists = _candidates(classes, scratch)

    # First every member of a list meets the most central one.
    mids = scratch.cut(lists.groupBy("v").agg(F.max(F.struct("central", "cid", "n")).alias("m")).select("v", F.col("m.cid").alias("b"), F.col("m.n").alias("bn")), "mids")
    close = F.least("n", "bn") * OF >= F.greatest("n", "bn") * SIMILAR
    star = lists.join(mids, "v").filter((F.col("cid") != F.col("b")) & close).select(F.col("cid").alias("a"), "b").distinct()
    first, sets = _compare(star, classes, docs, scratch)
    links = first.filter("linked").select("a", "b")
    member = components(links, scratch)

    # Lists across components: members near their centres, and others that may be linked with them or with each other.
    labelled = lists.select("v", "cid").join(member.toDF("cid", "comp"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    spans = labelled.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("v")
    spans = scratch.cut(spans.join(mids, "v").select("v", F.col("b").alias("c")), "spans")
    far = _far(lists, spans, first, member, classes, scratch)
    scratch.drop(lists, mids)
    near = first.select(F.col("b").alias("c"), F.col("a").alias("cid"), "linked").join(spans.select("c").distinct(), "c", "left_semi")
    near = near.join(member.toDF("cid", "comp"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid")).join(classes.select("cid", "n"), "cid")
    members = near.select("c", "cid", "comp", "n", "linked").union(far.select("c", "cid", "comp", "n", F.lit(False)))
    more = _sets_of(far.select("cid").distinct().join(sets.select("cid"), "cid", "left_anti"), classes, docs, scratch)
    late = _crowd(members, sets.union(more), scratch)
    scratch.drop(sets, more, far)

    # The later links join components.
    for side in ("a", "b"):
        late = late.join(member.toDF(side, "comp"), side, "left").withColumn(side, F.coalesce("comp", side)).select("a", "b")
    merged = components(late, scratch)
    whole = classes.select("cid", "digest", "rep_id").join(member.toDF("cid", "comp"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    whole = whole.join(merged.toDF("comp", "over"), "comp", "left").withColumn("comp", F.coalesce("over", "comp"))
    lowest = whole.groupBy("comp").agg(F.min("rep_id").alias("component_id"))
    named = whole.join(lowest, "comp").select("digest", "component_id")
    linked_rows = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").join(named, "digest").select("doc_id", "n_shingles", "component_id", "text_key")
    alone_rows = rows.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_key")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    return linked_rows.union(alone_rows).select("doc_id", "n_shingles", "component_id", kept, "text_key")


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, the one with the smallest doc_id.

    A row goes by its doc_id and its text, so of two texts under one doc_id each is judged for
    itself, and of rows that repeat both one stays. Null texts, texts without words and null
    doc_ids stay. Columns are passed on whatever their names.
    """
    scratch = Scratch(spark, "one_of_each")
    found = scratch.cut(near_duplicates(spark, docs).filter("doc_id IS NOT NULL"), "found")
    fate = found.groupBy("doc_id", "text_key").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n")).filter("NOT kept OR n > 1")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = (F.col("row")["doc_id"].cast("long") == F.col("doc_id")) & (F.xxhash64(F.col("row")["text"].cast("string")) == F.col("text_key"))
    met = rows.join(fate, own, "left").filter("kept IS NULL OR kept")
    again = met.filter("n > 1").dropDuplicates(["doc_id", "text_key"])
    return met.filter("n IS NULL").union(again).select("row.*")


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
l AS (SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents LEFT JOIN n USING (doc_id) JOIN m ON m.a = doc_id)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM l
"""
