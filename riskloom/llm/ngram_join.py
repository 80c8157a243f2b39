"""N-gram Jaccard join: a grouped prefix join on word shingles.

A document's set holds its distinct ``words``-word shingles (ASCII letters lower-cased). Documents
of equal sets are one class. Shingles have one global order, rare ones first (by counts in a
bounded table of hash buckets, then by hash). Two sets of the wanted similarity share a shingle in
their prefixes, and as many more as the prefixes are made longer. Classes of equal prefix and size
are one group; only groups are posted under their prefix shingles, and a group that shares fewer
shingles than any partner needs is done with. Groups that remain are expanded to their classes, of
which all shingles are now posted: a class whose shared shingles are fewer than a partner needs
is done with too, the others keep a prefix in the order of the exact counts.

Candidates are verified on the texts in rounds that link nothing twice. In the first, classes are
compared with some leaders of their shingles' lists, those that share most of their shingles with
others and so are nearest to most; at last all pairs of different components that pass the size and
position filters are verified. Pairs inside one component need no check, as only their component is asked
for, so groups of many near copies cost about their number of rows. No list, bucket or group is
capped.

Null texts and texts without words have an empty set and are linked with nothing. Repeated rows
give repeated rows with one component; a null id never names a component that holds another id. An
empty table gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import (byte_texts, components, filter_bits, list_array, map_batches, map_slices, may_hold_udf,
                     rolled_hashes, shingle_sets, slices, stored, text_hashes)

#: Buckets of the table of shingle counts that orders shingles.
BUCKET_BITS = 17
#: One shingle in so many is added to the prefix.
EXTRA = 16
#: Before all pairs that are left: rounds of comparing classes with the leaders of their lists (as
#: many as this), at most so many pairs for two components.
ROUNDS, LEADERS, TRIES = 1, 12, 8


def _extra(n):
    """Shingles that a prefix is longer than needed for one shared shingle: two sets of the wanted
    similarity then share one more than the smaller of their extras. For integers and columns."""
    return n // EXTRA if isinstance(n, int) else F.floor(n / EXTRA)


def _sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    return shingle_sets(*text_hashes([t.lower() for t in texts]), words)


def _shingle_counts(docs: DataFrame, text_col: str, words: int) -> np.ndarray:
    """Runs of ``words`` words of all documents counted in 2^BUCKET_BITS buckets by their hash."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for part in slices(batch, text_col):
                h, _ = text_hashes([t.lower() for t in byte_texts(part, text_col)])
                total += np.bincount(_bucket(rolled_hashes(h, words)), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    rows = map_batches(docs.select(text_col), run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    got = rows.toArrow()
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _signatures(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(id, th: hash of the text, digest of the set, its size n, group, prefix)."""
    shared = docs.sparkSession.sparkContext.broadcast(_shingle_counts(docs, text_col, words))
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        counts = shared.value

        def f(batch: pa.RecordBatch) -> dict:
            digest, n, group, group2, prefix = [], [], [], [], []
            for s in _sets(byte_texts(batch), words):
                size = len(s)
                keep = size - (percent * size + 99) // 100 + 1 + _extra(size) if size else 0
                first = s[np.argsort(counts[_bucket(s)], kind="stable")[:keep]].view(np.int64)
                key = xxh3_128_digest(first.tobytes() + size.to_bytes(8, "little"))
                digest.append(xxh3_128_digest(s.tobytes()))
                n.append(size)
                group.append(int.from_bytes(key[:8], "little", signed=True))
                group2.append(int.from_bytes(key[8:], "little", signed=True))
                prefix.append(first)
            lengths = np.array([len(p) for p in prefix])
            return {"id": batch.column("id"), "th": batch.column("th"), "digest": digest, "n": n, "g": group,
                    "g2": group2, "prefix": list_array(np.concatenate(prefix), lengths, pa.int64())}
        return f

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    return map_slices(rows, make, f"id {kind}, th bigint, digest binary, n bigint, g bigint, g2 bigint, prefix array<bigint>")


def _without_singles(posted: DataFrame, of: str) -> DataFrame:
    """(token, of) rows whose token stands in another row too (and the first and last token of a
    partition). Rows are range-sorted, so a frequent token spreads over partitions."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # last row so far, and whether it is wanted already

        def out(token, g):
            return pa.RecordBatch.from_arrays([pa.array(token), pa.array(g)], names=["token", of])

        for batch in batches:
            if not batch.num_rows:
                continue
            token, g = (batch.column(c).to_numpy() for c in ("token", of))
            if held:
                token, g = np.concatenate([held[0], token]), np.concatenate([held[1], g])
            same = token[1:] == token[:-1]
            keep = np.concatenate([[True], same]) | np.concatenate([same, [True]])
            keep[0] = held is None or held[2] or (len(same) > 0 and bool(same[0]))
            last_wanted = len(same) > 0 and bool(same[-1])
            if keep[:-1].any():
                yield out(token[:-1][keep[:-1]], g[:-1][keep[:-1]])
            held = (token[-1:], g[-1:], last_wanted)
        if held:
            yield out(held[0], held[1])

    return map_batches(posted.repartitionByRange("token", of).sortWithinPartitions("token", of), run,
                       f"token bigint, {of} bigint")


def _texts_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(digest, text) of the classes in ``wanted`` (digest, row: id and text hash of one document).
    A bitmap keeps most other documents out of the join."""
    rows = wanted.select("digest", F.col("row.id").alias("_id"), F.col("row.th").alias("_th"))
    test = may_hold_udf(docs.sparkSession, filter_bits(rows.select(F.xxhash64("_id", "_th").alias("h")), "h"))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th")) \
        .where(test(F.xxhash64("id", "th")))
    return (own.join(rows, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
            .groupBy("digest").agg(F.first("text").cast("binary").alias("text")))


def _shingles(texts: DataFrame, words: int) -> DataFrame:
    """(token, cid): every shingle of every class."""

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            sets = _sets(byte_texts(batch), words)
            size = np.array([len(x) for x in sets])
            return {"token": np.concatenate(sets).view(np.int64), "cid": np.repeat(batch.column("cid").to_numpy(), size)}
        return f

    return map_slices(texts.select("cid", "text"), make, "token bigint, cid bigint")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b: class numbers) that have the similarity."""
    left, right = (texts.select(F.col("cid").alias(k), F.col("text").alias(f"t{k}")) for k in "ab")

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            ones, twos = (_sets(byte_texts(batch, c), words) for c in ("ta", "tb"))
            keep = np.zeros(len(ones), bool)
            for i, (x, y) in enumerate(zip(ones, twos)):
                if len(x) > len(y):
                    x, y = y, x
                if 100 * len(x) < percent * len(y) or not len(x):
                    continue
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            mask = pa.array(keep)
            return {"a": batch.column("a").filter(mask), "b": batch.column("b").filter(mask)}
        return f

    return map_slices(pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb"), make,
                      "a bigint, b bigint", "ta")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4,
         percent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id) of every row: the size of its set, and the smallest id that
    is reachable over links of 100 * shared >= ``percent`` * union shingles."""
    sigs = stored(_signatures(docs, id_col, text_col, words, percent), "signatures")
    some = sigs.where("n > 0")
    row = F.struct(F.col("id").isNull().alias("missing"), F.col("id").alias("id"), F.col("th").alias("th"))
    classes = stored(some.groupBy("digest").agg(F.min("id").alias("least"), F.min(row).alias("row"), F.first("n").alias("n"),
                                                F.first("g").alias("g")), "classes")

    def need(n):
        """Shingles that any partner of a set of ``n`` shares with it."""
        return F.floor((n * percent + 99) / 100)

    # lists of groups by prefix shingle; a group stays if it shares as many as a partner needs
    posted = some.groupBy("g", "g2").agg(F.first("prefix").alias("prefix")).select(F.explode("prefix").alias("token"), "g")
    lists = _without_singles(posted, "g")
    sizes = classes.groupBy("g").agg(F.min("n").alias("n"), F.count("*").alias("members"))
    shared = lists.groupBy("g").agg(F.count("*").alias("c"))
    open_ = (sizes.join(shared, "g", "left").where((F.col("c") >= 1 + _extra(need(F.col("n")))) | (F.col("members") > 1)))
    member = stored(classes.join(open_.select("g"), "g", "left_semi").select("digest", "n", "row")
                    .withColumn("cid", F.monotonically_increasing_id()), "members")
    texts = stored(_texts_of(docs, member, id_col, text_col).join(member.select("digest", "cid"), "digest")
                   .select("cid", "text"), "texts")

    # all shingles of these classes: those that none other has can't count towards a partner
    lists = stored(_without_singles(_shingles(texts, words), "cid"), "postings")
    per = Window.partitionBy("cid")
    enough = (lists.withColumn("c", F.count("*").over(per)).join(member.select("cid", "n"), "cid")
              .where(F.col("c") >= need(F.col("n"))).select("token", "cid", "n"))
    enough = stored(enough, "postings")
    df = enough.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    prefix = (enough.join(df, "token").withColumn("c", F.count("*").over(per)).where(F.col("c") >= need(F.col("n")))
              .withColumn("at", F.row_number().over(per.orderBy("df", "token")))
              .where(F.col("at") <= F.col("c") - need(F.col("n")) + 1).select("token", "cid", "n", "c", "at"))
    prefix = stored(prefix, "postings")

    def fits(n, m):
        return 100 * F.least(n, m) >= percent * F.greatest(n, m)

    def possible(pairs):
        """Pairs (nx, ny, k: shared prefix shingles) that may reach the similarity: before the end of
        the prefix that ends first all they share is in both, and no more than need - 1 follow it."""
        wanted = F.ceil(percent * (F.col("nx") + F.col("ny")) / (100 + percent))
        return pairs.where(fits(F.col("nx"), F.col("ny"))).where(
            F.col("k") + F.greatest(need(F.col("nx")), need(F.col("ny"))) - 1 >= wanted)

    left = prefix.withColumn("root", F.col("cid"))
    found = None
    for turn in range(ROUNDS):
        # what can still be linked, with the leaders of each list: those that share most of their
        # shingles with others are nearest to most; later rounds take others by hash
        h = F.struct((F.col("n") - F.col("c") if turn == 0 else F.lit(0)).alias("apart"), F.xxhash64("cid", F.lit(turn)).alias("h"))
        order = Window.partitionBy("token").orderBy("h", "cid")
        lead = (left.select("token", h.alias("h"), "cid", "n", "root").withColumn("r", F.row_number().over(order))
                .where(F.col("r") <= LEADERS).groupBy("token")
                .agg(F.collect_list(F.struct(F.col("cid").alias("y"), F.col("n").alias("ny"), F.col("root").alias("rooty"))).alias("l")))
        pairs = (left.join(lead, "token").select(F.col("cid").alias("x"), F.col("n").alias("nx"), F.col("root").alias("rootx"), F.inline("l"))
                 .where("rootx <> rooty")
                 .groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.least("rootx", "rooty").alias("ra"),
                          F.greatest("rootx", "rooty").alias("rb"), F.greatest("nx", "ny").alias("nx"), F.least("nx", "ny").alias("ny"))
                 .agg(F.count("*").alias("k")))
        best = Window.partitionBy("ra", "rb").orderBy(F.col("k").desc(), "a", "b")
        tried = possible(pairs).withColumn("r", F.row_number().over(best)).where(F.col("r") <= TRIES).select("a", "b")
        more = stored(_verified(tried, texts, words, percent), "edges")
        roots = stored(components(more if found is None else found.union(more)), "roots")
        found = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        entries = (prefix.join(roots, prefix["cid"] == roots["node"], "left")
                   .select("token", "cid", "n", "c", "at", F.coalesce("root", "cid").alias("root")))
        mixed = entries.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
        left = stored(entries.join(mixed.select("token"), "token"), "left")

    # what two components still share: all pairs that may reach the similarity
    x, y = (left.select("token", *[F.col(k).alias(k + side) for k in ("cid", "n", "c", "at", "root")]) for side in "xy")
    # at the first shingle that two prefixes share, what follows in either bounds the overlap
    wanted = F.ceil(percent * (F.col("nx") + F.col("ny")) / (100 + percent))
    rest = 1 + F.least(F.col("cx") - F.col("atx"), F.col("cy") - F.col("aty"))
    tried = (x.join(y, "token").where("rootx < rooty").where(fits(F.col("nx"), F.col("ny"))).where(rest >= wanted)
             .select(F.col("cidx").alias("a"), F.col("cidy").alias("b")).distinct())
    more = stored(_verified(tried, texts, words, percent), "edges")
    # known components as stars, with the new links between them
    roots = stored(components(found.union(more)), "roots")

    linked = member.join(roots, member["cid"] == roots["node"]).select("digest", "root").join(
        classes.select("digest", "least"), "digest")
    first = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.select("digest", "least").join(linked.join(first, "root").select("digest", "component_id"), "digest", "left") \
        .withColumn("component_id", F.when(F.col("component_id").isNull(), F.col("least")).otherwise(F.col("component_id")))
    return (sigs.select("id", "digest", "n").join(named.select("digest", "component_id"), "digest", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")))
