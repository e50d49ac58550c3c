"""Exact set-similarity join on word shingles by prefix filters under several global token orders.

Steps, all over whole texts and all rows:

1. Each text becomes a set of 64-bit shingle hashes.  Texts with equal sets are one *class* from here on, whatever the size of a group of copies.
2. A counting exchange (see ``exchange``) tells in how many rows each shingle stands; only shingles of two rows or more come back, as others cannot be
   shared.  Sizes of whole sets are kept, so similarities stay exact.
3. A set's prefix under an order is its first ``size - ceil(t * size) + 1`` shingles.  Two sets with Jaccard similarity of t or more share a prefix
   shingle under *every* global order.  The orders here all put rare shingles first (by the power of two of their frequency) and break ties by different
   scrambles.  Shingles of one row lead each order and are not sent.
4. In each bucket (first order's prefix shingle) the class with the least share of unshared shingles leads.  All classes that meet a leader, in whatever
   bucket, are its group, so every candidate pair lies in some group, and the hundreds of buckets of a group of near copies are one or a few groups.
5. A group is cut into blocks of about ``block`` classes and ``block_bytes`` bytes; each pair of blocks is one unit of work, dealt to any task.  In it pairs
   are candidates if their sizes allow t, if they share a prefix shingle under *each* order (the filters are intersected on bit matrices), and if no
   lesser leader's group holds both, so each pair is looked at once.  Candidates are verified by their exact number of common shingles.
6. No row is made for a candidate: a unit of work gives each class's number of links and a spanning forest of them, both linear in its classes.

The result is exact but for collisions of 64-bit hashes: the components of all links of t or more, and all these links (``similarity_links``).  The work grows
with the square of a group of *different* sets that share prefixes, at some nanoseconds a pair.

Nulls and ties: null, empty or blank texts have an empty set and link with nothing; rows without ``doc_id`` are measured but take no part in links and have no
component; repeated rows are copies, and rows that share a ``doc_id`` link with what any of them links with.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.components import connected_components
from quillon.llm.exchange import ROW, shard_cuts, shards_for
from quillon.llm.shared import written
from quillon.llm.text import WordCoder, in_chunks, mix, pack, pack_sorted, release, shingles, unpack, unpack_sorted, words

SETS = "doc_id long, n_shingles long, hi long, lo long, tokens binary, freq binary"
#: A class's set, the first order's prefix as keys, and each order's prefix as packed hashes.
CANDIDATES = "rep long, n_shingles long, tokens binary, keys array<long>, prefixes array<binary>"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["chunk", "shard", "kind", "head", "body"])


def _chunks(n: int, chunk_bytes: int, shards: int):
    def run(batches):
        task, seq = TaskContext.get().partitionId(), 0
        for ids, texts in in_chunks(batches, chunk_bytes):
            coder = WordCoder()
            sets = [np.unique(shingles(coder.hashed(words(t)), n)) for t in texts]
            sizes = np.array([len(s) for s in sets], np.int64)
            with np.errstate(over="ignore"):
                hi = np.array([mix(s, 11).sum(dtype=np.uint64) for s in sets], np.uint64)
                lo = np.array([mix(s, 12).sum(dtype=np.uint64) for s in sets], np.uint64)
            nulls = np.array([d is None for d in ids], np.uint8)
            keys = np.array([0 if d is None else d for d in ids], np.int64)
            chunk, seq = (task << 24) | seq, seq + 1
            meta = np.int64(len(ids)).tobytes() + nulls.tobytes() + keys.tobytes() + sizes.tobytes() + hi.tobytes() + lo.tobytes()
            out = [(chunk, chunk % shards, 0, meta, b"")]
            every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(every, kind="stable")
            every, owner = every[order], owner[order]
            cuts = shard_cuts(every, 64, shards)
            for s in range(shards):
                a, b = cuts[s], cuts[s + 1]
                if b > a:
                    out.append((chunk, s, 1, pack(owner[a:b]), pack_sorted(every[a:b])))
            del coder, sets, every, owner, order, texts
            for at in range(0, len(out), 64):
                yield _rows(out[at : at + 64])
            del out
            release()

    return run


def _count(table: pa.Table) -> pa.Table:
    """A shard's answer: to each chunk its shingles that stand in two rows or more, their owners and frequencies."""
    rows = list(zip(*(table.column(c).to_pylist() for c in ("chunk", "shard", "kind", "head", "body")), strict=True))
    del table
    out = [r for r in rows if r[2] == 0]
    own = [(r[0], r[1], unpack_sorted(r[4]), r[3]) for r in rows if r[2] == 1]
    del rows
    if own:
        every = np.concatenate([x[2] for x in own])
        every.sort()
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        n = np.diff(np.concatenate([first, [len(every)]]))
        every, n = every[first][n > 1], n[n > 1]
        for chunk, shard, h, owners in own:
            at = np.searchsorted(every, h)
            at[at == len(every)] = 0
            shared = every[at] == h if len(every) else np.zeros(len(h), bool)
            if shared.any():
                head = pack(unpack(owners)[shared])
                freq = pack(n[at[shared]])
                out.append((chunk, shard, 1, len(head).to_bytes(4, "little") + head + freq, pack_sorted(h[shared])))
        del every, own
    release()
    return pa.Table.from_batches([_rows(out)])


def _assemble(table: pa.Table) -> pa.Table:
    """A chunk's rows with their shared shingles, ascending."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("shard", "kind", "head", "body")), strict=True), key=lambda r: r[:2])
    del table
    meta = next(r[2] for r in rows if r[1] == 0)
    m = int(np.frombuffer(meta, np.int64, 1)[0])
    nulls = np.frombuffer(meta, np.uint8, m, 8).astype(bool)
    keys, sizes, hi, lo = np.frombuffer(meta[8 + m :], np.int64).reshape(4, m)
    owners, tokens, freq = [], [], []
    for _, kind, head, body in rows:
        if kind == 1:
            k = int.from_bytes(head[:4], "little")
            owners.append(unpack(head[4 : 4 + k]))
            freq.append(unpack(head[4 + k :]))
            tokens.append(unpack_sorted(body))
    del rows
    o = np.concatenate(owners) if owners else np.empty(0, np.int64)
    t = np.concatenate(tokens) if tokens else np.empty(0, np.uint64)
    f = np.concatenate(freq) if freq else np.empty(0, np.int64)
    order = np.lexsort((t, o))
    t, f = t[order], f[order]
    cuts = np.searchsorted(o[order], np.arange(m + 1))
    del o, owners, tokens, freq, order
    release()
    return pa.table(
        {
            "doc_id": pa.array(keys, mask=nulls), "n_shingles": pa.array(sizes), "hi": pa.array(hi), "lo": pa.array(lo),
            "tokens": pa.array([pack_sorted(t[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
            "freq": pa.array([pack(f[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
        }
    )


def _needed(size: int, t: Fraction) -> int:
    """ceil(t * size)."""
    return -(-size * t.numerator // t.denominator)


def _prefixes(t: Fraction, orders: int):
    """Classes whose shared shingles reach into their prefix, with their prefixes."""

    def run(batches):
        for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            out: list[list] = [[], [], [], [], []]
            for rep, size, tokens, freq in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = unpack_sorted(tokens)
                room = size - _needed(size, t) + 1 - (size - len(h))
                if room <= 0:
                    continue
                rarity = np.floor(np.log2(unpack(freq))).astype(np.int64)
                firsts = [np.sort(h[np.lexsort((mix(h, 100 + k), rarity))[:room]]) for k in range(orders)]
                for column, value in zip(out, (rep, size, tokens, firsts[0].view(np.int64), [pack_sorted(x) for x in firsts]), strict=True):
                    column.append(value)
            if out[0]:
                types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(out, types, strict=True)], ["rep", "n_shingles", "tokens", "keys", "prefixes"])
        release()

    return run


def _shared_counts(a: list[np.ndarray], b: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many values each set of ``a`` shares with each set of ``b``."""
    out = np.zeros((len(a), len(b)), np.float32)
    ta, ra = np.concatenate(a), np.repeat(np.arange(len(a)), [len(x) for x in a])
    tb, rb = np.concatenate(b), np.repeat(np.arange(len(b)), [len(x) for x in b])
    if a is b:
        both, n = np.unique(ta, return_counts=True)
        both = both[n > 1]
    else:
        both = np.intersect1d(ta, tb)
    for at in range(0, len(both), columns):
        part = both[at : at + columns]
        sides = []
        for tokens, rows, n in ((ta, ra, len(a)), (tb, rb, len(b))):
            place = np.searchsorted(part, tokens)
            place[place == len(part)] = 0
            held = part[place] == tokens
            ones = np.zeros((n, len(part)), np.float32)
            ones[rows[held], place[held]] = 1
            sides.append(ones)
            if a is b:
                sides.append(ones)
                break
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def _forest(hit: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewest links that join what ``hit`` (rows u, columns v) joins: each node with a root."""
    rows, left, right = np.flatnonzero(hit.any(1)), [], []
    open_row = np.zeros(len(u), bool)
    open_row[rows] = True
    for i in rows:
        if not open_row[i]:
            continue
        tree, columns = np.array([i]), np.zeros(len(v), bool)
        open_row[i] = False
        members = [tree]
        while len(tree):
            new = hit[tree].any(0) & ~columns
            columns |= new
            tree = np.flatnonzero(hit[:, new].any(1) & open_row)
            open_row[tree] = False
            members.append(tree)
        nodes = np.concatenate([u[np.concatenate(members)], v[columns]])
        left.append(nodes)
        right.append(np.full(len(nodes), u[i]))
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    left, right = np.concatenate(left), np.concatenate(right)
    return left[left != right], right[left != right]


def _compare(t: Fraction, orders: int, pairs: bool):
    """Links of the pairs of blocks that lie together in a partition: the pairs, or a forest of them (kind 0) and each class's number (kind 1)."""

    def linked(rows: list[tuple]) -> list[np.ndarray]:
        leader, lo, hi = rows[0][:3]
        left = [r for r in rows if r[3] == lo]
        right = left if lo == hi else [r for r in rows if r[3] == hi]
        nothing = [np.empty(0, np.int64)] * 3
        if not left or not right or (lo == hi and len(left) < 2):
            return nothing

        def sides(value, rows_of, columns_of):
            """Both sides' arrays; the same list where the sides are one, as that is cheaper to count."""
            a = [value(left[i]) for i in rows_of]
            return (a, a) if lo == hi and rows_of is columns_of else (a, [value(right[j]) for j in columns_of])

        all_rows = np.arange(len(left))
        all_columns = all_rows if lo == hi else np.arange(len(right))
        ra, sa = np.array([r[4:6] for r in left], np.int64).T
        rb, sb = np.array([r[4:6] for r in right], np.int64).T
        least = np.minimum(sa[:, None], sb[None, :])
        may = (t.denominator * least >= t.numerator * np.maximum(sa[:, None], sb[None, :])) & (ra[:, None] != rb[None, :])
        if lo == hi:
            may = np.triu(may, 1)
        for k in range(orders):
            if not may.any():
                return nothing
            may &= _shared_counts(*sides(lambda r, k=k: unpack_sorted(r[7][k]), all_rows, all_columns)) > 0
        lesser = sides(lambda r: np.array([x for x in r[8] if x < leader], np.int64), all_rows, all_columns)
        if any(len(x) for x in lesser[0]) and any(len(x) for x in lesser[1]):
            may &= _shared_counts(*lesser) == 0
        i, j = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
        if not len(i):
            return nothing
        if lo == hi:
            i = j = np.union1d(i, j)
        shared = _shared_counts(*sides(lambda r: unpack_sorted(r[6]), i, j))
        may, sa, sb, ra, rb = may[np.ix_(i, j)], sa[i], sb[j], ra[i], rb[j]
        hit = may & (t.denominator * shared >= t.numerator * (sa[:, None] + sb[None, :] - shared))
        if pairs:
            x, y = np.nonzero(hit)
            return [np.minimum(ra[x], rb[y]), np.maximum(ra[x], rb[y]), shared[x, y]]
        u, v = _forest(hit, ra, rb)
        n = np.concatenate([hit.sum(1), hit.sum(0)])
        nodes, n = np.concatenate([ra, rb])[n > 0], n[n > 0]
        return [np.repeat([0, 1], [len(u), len(nodes)]), np.concatenate([u, nodes]), np.concatenate([v, n])]

    names = ["u", "v", "n_shared"] if pairs else ["kind", "u", "v"]

    def run(batches):
        held: list[tuple] = []
        done: list[list[np.ndarray]] = []
        size = 0

        def given():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*done, strict=True)], names)

        for batch in (whole.slice(at, 200) for whole in batches for at in range(0, whole.num_rows, 200)):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][:3] != row[:3]:
                    done.append(linked(held))
                    held, size = [], size + len(done[-1][0])
                    if size > 100_000 or len(done) > 2_000:
                        yield given()
                        done, size = [], 0
                held.append(row)
        if held:
            done.append(linked(held))
        if done:
            yield given()
        held.clear()
        release()

    return run


def _classes(docs: DataFrame, n: int, t: Fraction, orders: int, chunk_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sets of all rows, classes (hi, lo, rep) and the candidates among the classes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    counted = rows.mapInArrow(_chunks(n, chunk_bytes, shards_for(docs)), ROW).groupBy("shard").applyInArrow(_count, ROW)
    sets = written(counted.groupBy("chunk").applyInArrow(_assemble, SETS), "shingle-sets", sweep=True)
    classes = sets.where("n_shingles > 0 and doc_id is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"))
    classes = written(classes, "set-classes", sweep=True)
    keys = classes.select(F.col("hi").alias("c_hi"), F.col("lo").alias("c_lo"), "rep")
    same = (F.col("hi") == F.col("c_hi")) & (F.col("lo") == F.col("c_lo")) & (F.col("doc_id") == F.col("rep"))
    one = sets.where("n_shingles > 0").join(keys, same).dropDuplicates(["rep", "hi", "lo"]).select("rep", "n_shingles", "tokens", "freq")
    return sets, classes, written(one.mapInArrow(_prefixes(t, orders), CANDIDATES), "candidates", sweep=True)


def _dealt(found: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """Every pair of blocks of every leader's group, the classes of both together."""
    grams = found.select(
        "rep",
        F.octet_length("tokens").alias("weight"),
        (F.lit(1.0) - F.size("keys") / F.col("n_shingles")).alias("alone"),
        F.explode("keys").alias("token"),
    )
    bucket = grams.groupBy("token").agg(F.min(F.struct("alone", "rep")).alias("lead"), F.min("rep").alias("least"), F.max("rep").alias("last")).where("least < last")
    bucket = bucket.select(F.col("token").alias("b_token"), F.col("lead.rep").alias("leader"))
    members = grams.join(bucket, F.col("token") == F.col("b_token")).groupBy("leader", "rep").agg(F.max("weight").alias("weight"))
    members = written(members, "groups", sweep=True)
    blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("weight") / block_bytes)).cast("int")
    cuts = members.groupBy("leader").agg(blocks.alias("blocks")).withColumnRenamed("leader", "of")
    rows = members.join(cuts, F.col("leader") == F.col("of")).select("leader", "rep", "blocks", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("own"))
    dealt = rows.select("leader", "rep", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("leader", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "rep")
    leaders = members.groupBy(F.col("rep").alias("l_rep")).agg(F.collect_set("leader").alias("leaders"))
    sets = found.drop("keys").join(leaders, F.col("rep") == F.col("l_rep")).withColumnRenamed("rep", "s_rep")
    return dealt.join(sets, F.col("rep") == F.col("s_rep")).select("leader", "lo", "hi", "own", "rep", "n_shingles", "tokens", "prefixes", "leaders")


def _compared(found: DataFrame, t: Fraction, orders: int, block: int, block_bytes: int, pairs: bool) -> DataFrame:
    dealt = _dealt(found, block, block_bytes).repartition("leader", "lo", "hi").sortWithinPartitions("leader", "lo", "hi")
    return dealt.mapInArrow(_compare(t, orders, pairs), "u long, v long, n_shared long" if pairs else "kind long, u long, v long")


def similarity_components(
    docs: DataFrame, n: int = 5, threshold: str = "0.8", orders: int = 2, chunk_bytes: int = 6 << 20, block: int = 512, block_bytes: int = 4 << 20
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id that links reach), n_links.

    ``threshold`` is a decimal or a fraction, taken exactly.  ``n_links`` is the number of other classes, that is of other sets of shingles, that
    link with the row's class; copies of one set are no links.
    """
    t = Fraction(threshold)
    sets, classes, found = _classes(docs, n, t, orders, chunk_bytes)
    links = written(_compared(found, t, orders, block, block_bytes, False), "set-links", sweep=True)
    component = connected_components(links.where("kind = 0").select("u", "v")).select("node", "component")
    degree = links.where("kind = 1").groupBy("u").agg(F.sum("v").alias("n_links"))
    final = component.join(degree, F.col("node") == F.col("u")).select("node", "component", "n_links")
    named = classes.join(final, F.col("rep") == F.col("node"), "left").select(
        F.col("hi").alias("c_hi"), F.col("lo").alias("c_lo"), F.coalesce("component", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    linked = sets.select("doc_id", "n_shingles", "hi", "lo").withColumn("linked", (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    out = linked.join(named, F.col("linked") & (F.col("hi") == F.col("c_hi")) & (F.col("lo") == F.col("c_lo")), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def similarity_links(
    docs: DataFrame, n: int = 5, threshold: str = "0.8", orders: int = 2, chunk_bytes: int = 6 << 20, block: int = 512, block_bytes: int = 4 << 20
) -> DataFrame:
    """One row per link between two classes: u < v (the smallest doc_id of each class) and n_shared, the shingles that both hold."""
    t = Fraction(threshold)
    _, _, found = _classes(docs, n, t, orders, chunk_bytes)
    return _compared(found, t, orders, block, block_bytes, True)
