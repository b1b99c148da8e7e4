"""MinHash near-duplicates with HyperMinHash registers.

One pass over the texts gives each document its set size, a 128-bit fingerprint of its shingle
set and 128 registers. A register keeps, for the smallest hash of its bucket, the number of
leading zeros (6 bits) and the next 10 bits. Buckets that got no shingle borrow the register of
another bucket in a fixed order (optimal densification), so small sets can be banded as well.

Documents of equal fingerprints form a class, and only one of each class goes on, so that
groups of copies cost nothing. 32 bands of four registers propose pairs: first each member
of a band's bucket with the bucket's smallest id, which joins most groups at a cost that is linear
in their size. What is compared afterwards are only members of one bucket that are still in
different components: pair by pair in buckets of up to 32. Members of larger ones are put into buckets again, by their rarest
shingles, so that texts of one template that aren't near-duplicates part: two sets as similar as asked share one of these. Such buckets are
worked off alike, pair by pair or with their smallest id first; what is still apart in a large one is compared in blocks of
documents, whose common shingles are counted by matrix products. No pair within a component is
looked for, none across is left out. Two sets of similarity 0.85 (0.8) share no band with a
probability of about 6e-11 (5e-8).

A pair's register agreement, corrected for the chance that different hashes give equal
registers, estimates its similarity. A pair is dropped on that estimate only if sets as similar
as the threshold would agree so little with a probability below 1e-12 (Chernoff's bound, which
holds for the binomial count of agreeing registers); a set of fewer than twice as many
shingles as registers borrows registers, so its pairs are never dropped. All others are confirmed
on the full shingle sets of their texts.

Edge cases: null, empty or wordless texts have no shingles, are linked with nothing and kept.
A row of null doc_id is linked with nothing, has a null component and is kept. Rows that
repeat a doc_id are judged one by one: each gets the component of its own text, and one is dropped
only if its own text is a near-copy of a document of smaller id; rows that repeat a doc_id and its text
are one document and stay or go together. An empty table gives no rows. Extra columns are
ignored by near_duplicates and kept by drop_near_duplicates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import components
from lodestone.llm.shared import free_names, stored
from lodestone.llm.words import Words, mix, shingles, slices

REGISTERS, BANDS, MANTISSA = 128, 32, 10
WIDTH = REGISTERS // BANDS
SMALL, BLOCK, COLUMNS = 32, 512, 4096
SLOTS = 1 << 16  # counts that put shingles in order
#: Shingles of a block of documents on average: its texts take some 20 times as many bytes.
BLOCK_SHINGLES = 1_000_000
#: A pair as similar as the threshold is dropped by its estimate with at most this probability.
LOSS = 1e-12
#: A bucket with more than this share of all band rows is hot; there can't be more than its inverse.
HOT_SHARE, HOT_LEAST = 1e-4, 256
#: Narrow rows (ids, buckets) sent to every executor at most; beyond, they are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_NONE = np.uint64(2**64 - 1)
_PROBES = np.random.default_rng(11).integers(0, REGISTERS, (64, REGISTERS))


def registers(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """n x REGISTERS compressed registers of the sets given as (row, hash); rows of no hash are 0."""
    g = mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    smallest = np.full(n * REGISTERS, _NONE)
    np.minimum.at(smallest, rows * REGISTERS + (g >> np.uint64(57)).astype(np.int64), g << np.uint64(7))
    full = (smallest != _NONE).reshape(n, REGISTERS)
    zeros = (53 - np.frexp((smallest >> np.uint64(11)).astype(np.float64))[1]).astype(np.uint64)
    rest = (smallest << np.minimum(zeros + np.uint64(1), np.uint64(63))) >> np.uint64(64 - MANTISSA)
    own = ((zeros << np.uint64(MANTISSA)) | rest).astype(np.uint16).reshape(n, REGISTERS)
    out = np.where(full, own, np.uint16(0))
    row, bucket = np.nonzero(~full & full.any(axis=1, keepdims=True))
    for probe in _PROBES:
        if not len(row):
            break
        donor = probe[bucket]
        found = full[row, donor]
        out[row[found], bucket[found]] = own[row[found], donor[found]]
        row, bucket = row[~found], bucket[~found]
    if len(row):  # the next full bucket, going round
        place = np.where(np.tile(full, 2), np.arange(2 * REGISTERS), 2 * REGISTERS)
        following = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1]
        out[row, bucket] = own[row, following[row, bucket] % REGISTERS]
    return out


def chance(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Probability that registers of different smallest hashes agree, by set sizes."""
    x, y = (np.maximum(n / REGISTERS, 1.0)[:, None] for n in (n_a, n_b))
    k = np.arange(58)[None, :]
    share = lambda m: (1 - 2.0 ** -(k + 1)) ** m - (1 - 2.0**-k) ** m
    return (share(x) * share(y)).sum(axis=1) / 2**MANTISSA


def sign(documents: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, f1, f2, signature) of each row."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in slices(batches):
            n = part.num_rows
            row, h = shingles(found, words)
            size = np.bincount(row, minlength=n)
            f1, f2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            np.add.at(f1, row, mix(h))
            np.add.at(f2, row, mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
            signature = [x.tobytes() for x in registers(row, h, n)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_hash"), pa.array(size.astype(np.int64)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(signature, pa.binary())],
                ["doc_id", "text_hash", "n_shingles", "f1", "f2", "signature"],
            )

    return _identified(documents).mapInArrow(signed, "doc_id long, text_hash long, n_shingles long, f1 long, f2 long, signature binary")


def _identified(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text): a row is known by its id and the hash of its text."""
    return documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")


def most_apart(n: np.ndarray, level: float) -> np.ndarray:
    """The largest share of n registers in agreement whose probability, each agreeing with
    probability level, is below LOSS by Chernoff's bound; -1 if there is none."""
    low, high = np.zeros(len(n)), np.full(len(n), level)
    need = -np.log(LOSS) / n
    apart = lambda q: np.where(q > 0, q * np.log(np.maximum(q, 1e-300) / level), 0.0) + (1 - q) * np.log((1 - q) / (1 - level))
    for _ in range(40):
        middle = (low + high) / 2
        far = apart(middle) >= need
        low, high = np.where(far, middle, low), np.where(far, high, middle)
    return np.where(apart(np.zeros(len(n))) >= need, low, -1.0)


def _promising(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and registers allow the similarity asked for."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("signature").alias(f"s{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    least = float(most_apart(np.array([float(REGISTERS)]), min(percent / 100, 1 - 1e-9))[0])

    def estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(x).to_pylist()), np.uint16).reshape(-1, REGISTERS) for x in ("sa", "sb"))
            na, nb = (batch.column(x).to_numpy(zero_copy_only=False).astype(float) for x in ("na", "nb"))
            by_chance = chance(na, nb)
            similarity = ((a == b).mean(axis=1) - by_chance) / (1 - by_chance)
            yield batch.filter(pa.array((np.minimum(na, nb) < 2 * REGISTERS) | (similarity > least))).select(["a", "b"])

    return sized.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(estimated, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets meet 100 * intersection >= percent * union."""
    side = lambda x: texts.select(F.col("rep").alias(x), F.col("text").alias(f"t{x}"))

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.zeros(0, np.uint64)
        for part, found in slices(batches, "tb"):
            row, h = shingles(found, words)
            at = np.searchsorted(row, np.arange(part.num_rows + 1))
            a = part.column("a").to_pylist()
            keep = np.zeros(part.num_rows, bool)
            for i in range(part.num_rows):
                if a[i] != last:
                    last, own = a[i], shingles(Words(part.column("ta").slice(i, 1)), words)[1]
                other = h[at[i] : at[i + 1]]
                where = np.searchsorted(own, other)
                common = int((own[np.minimum(where, len(own) - 1)] == other).sum()) if len(own) else 0
                keep[i] = common > 0 and 100 * common >= percent * (len(own) + len(other) - common)
            yield part.filter(pa.array(keep)).select(["a", "b"])

    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb")
    return both.mapInArrow(checked, "a long, b long")


def _labels(links: DataFrame) -> DataFrame:
    return components(links).select(F.col("node").alias("rep"), "component")


def _apart(members: DataFrame, label: DataFrame) -> DataFrame:
    """Members of buckets that hold several components so far, with these and the size of their bucket."""
    labelled = members.join(label, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    several = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low != high")
    return stored(labelled.join(_sized(several.select("key", "size")), "key").select("key", "rep", "component", "size"), "neardup-apart")


def _of_small(rows: DataFrame) -> DataFrame:
    """Pairs of different components inside buckets of at most SMALL members."""
    groups = rows.where(F.col("size") <= SMALL).groupBy("key").agg(F.collect_list(F.struct("component", "rep")).alias("g"))
    pair = lambda x: F.transform(F.filter("g", lambda y: x["component"] < y["component"]), lambda y: F.struct(F.least(x["rep"], y["rep"]).alias("a"), F.greatest(x["rep"], y["rep"]).alias("b")))
    return groups.select(F.explode(F.flatten(F.transform("g", pair))).alias("p")).select("p.a", "p.b").distinct()


def _rare(rows: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(key, rep): the rarest shingles of each member of a bucket of more than SMALL members.

    Of n shingles two sets of the similarity asked for share ceil(percent * n / 100) at least, so in any common order of
    all shingles they share one of the first n less that, plus one, of either. The order is that of a table of SLOTS
    counts over these texts, then of the hash: words of a template that all of them have come last.
    """
    ids = _sized(rows.where(F.col("size") > SMALL).select("rep").distinct())
    large = stored(texts.join(ids, "rep", "left_semi"), "neardup-large")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.int64)
        for _, found in slices(batches):
            n += np.bincount((shingles(found, words)[1] >> np.uint64(40)).astype(np.int64) % SLOTS, minlength=SLOTS)
        slot = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(n[slot])], ["slot", "n"])

    sums = large.mapInArrow(counted, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    count = np.zeros(SLOTS, np.int64)
    count[sums["slot"].to_numpy()] = sums["n"].to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(count)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in slices(batches):
            row, h = shingles(found, words)
            order = np.lexsort((h, shared.value[(h >> np.uint64(40)).astype(np.int64) % SLOTS], row))
            row, h = row[order], h[order]
            size = np.bincount(row, minlength=part.num_rows)
            place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
            keep = place <= (size + -percent * size // 100)[row]
            yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), part.column("rep").take(pa.array(row[keep]))], ["key", "rep"])

    return large.mapInArrow(first, "key long, rep long")


def _stars(rows: DataFrame) -> DataFrame:
    """Pairs of each member of a bucket of more than SMALL with the bucket's smallest."""
    large = rows.where(F.col("size") > SMALL)
    leaders = _sized(large.groupBy("key").agg(F.min("rep").alias("leader")))
    return large.join(leaders, "key").where("rep != leader").select(F.least("leader", "rep").alias("a"), F.greatest("leader", "rep").alias("b")).distinct()


def _links_between(table: pa.Table, words: int, percent: int) -> pa.Table:
    """Links that join the components of a table(rep, component, text), no more than needed.

    Common shingles of all its texts are counted by products of 0/1 matrices.
    """
    found = Words(table.column("text").combine_chunks())
    n = table.num_rows
    row, h = shingles(found, words)
    size = np.bincount(row, minlength=n).astype(np.float64)
    _, column, count = np.unique(h, return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    keep = count[column] > 1
    row, column = row[keep], shared[column[keep]]
    common = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, [low, low + COLUMNS]))
        held = np.zeros((n, COLUMNS), np.float32)
        held[row[part], column[part] - low] = 1
        common += held @ held.T
    component = table.column("component").to_numpy()
    met = (100 * common >= percent * (size[:, None] + size[None, :] - common)) & (common > 0) & (component[:, None] < component[None, :])
    rep, parent, links = table.column("rep").to_pylist(), {}, []

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, j in np.argwhere(met).tolist():
        x, y = root(int(component[i])), root(int(component[j]))
        if x != y:
            parent[x] = y
            links.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def _of_large(rows: DataFrame, classes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between components of buckets of more than SMALL members.

    Of buckets with the same members one is looked at. A bucket's largest component and the rest of
    it are dealt at random into blocks of about BLOCK documents and BLOCK_SHINGLES shingles; every
    block of the rest meets every block of the bucket in one group, so each pair across its components
    is looked at and no pair is made a row. A group holds two blocks, however large its bucket is.
    """
    large = rows.where(F.col("size") > SMALL)
    alike = large.groupBy("key").agg(F.sum(F.xxhash64("rep").cast("decimal(20)")).alias("x"), F.sum(F.xxhash64("rep", F.lit(1)).cast("decimal(20)")).alias("y"), F.count("*").alias("n"))
    large = large.join(_sized(alike.groupBy("x", "y", "n").agg(F.min("key").alias("key")).select("key")), "key", "left_semi")
    docs = stored(large.join(classes.select("rep", "n_shingles"), "rep").select("key", "rep", "component", "n_shingles"), "neardup-large")
    sizes = docs.groupBy("key", "component").agg(F.count("*").alias("count"), F.sum("n_shingles").alias("shingles"))
    sizes = sizes.groupBy("key").agg(F.max(F.struct("count", "shingles", "component")).alias("most"), F.sum("count").alias("all"), F.sum("shingles").alias("volume"))
    blocks = lambda n, volume: F.ceil(F.greatest(n / BLOCK, volume / BLOCK_SHINGLES)).cast("int")
    sizes = sizes.where(F.col("all") > F.col("most.count")).select("key", F.col("most.component").alias("most"), blocks(F.col("all") - F.col("most.count"), F.col("volume") - F.col("most.shingles")).alias("n_rest"), blocks(F.col("most.count"), F.col("most.shingles")).alias("n_most"))
    dealt = docs.join(_sized(sizes), "key").withColumn("in_most", F.col("component") == F.col("most"))
    dealt = dealt.withColumn("block", F.when(F.col("in_most"), F.col("n_rest") + F.pmod(F.xxhash64("rep"), F.col("n_most"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("n_rest"))))
    others = F.sequence(F.lit(0), F.when(F.col("in_most"), F.col("n_rest")).otherwise(F.col("n_rest") + F.col("n_most")) - 1)
    dealt = dealt.select("rep", "component", "key", "block", F.explode(others).alias("other")).select("rep", "component", "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    groups = dealt.join(texts, "rep").groupBy("key", "low", "high")
    return groups.applyInArrow(lambda table: _links_between(table, words, percent), "a long, b long")


def _sized(ids: DataFrame) -> DataFrame:
    """Narrow rows, counted, and marked for broadcast if they are BROADCAST_IDS at most, so that the
    rows of one hot bucket are joined where they are."""
    ids = stored(ids, "neardup-ids")
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _classes(signed: DataFrame) -> DataFrame:
    """(f1, f2, n_shingles, signature, doc_id, text_hash, copies, rep) of each distinct shingle set.

    rep, the class's node, is its smallest doc_id. Where several sets share that doc_id, those beyond
    the first get a hash of their set instead, so no two classes meet in a node.
    """
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("f1", "f2", "n_shingles", "signature")
    classes = stored(classes.agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.count("*").alias("copies")).select("f1", "f2", "n_shingles", "signature", "least.*", "copies"), "neardup-sets")
    shared = stored(classes.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.struct("f1", "f2", "n_shingles")).alias("first")).where("n > 1").select("doc_id", "first"), "neardup-shared")
    other = F.col("first").isNotNull() & (F.struct("f1", "f2", "n_shingles") != F.col("first"))
    return classes.join(shared, "doc_id", "left").withColumn("rep", F.when(other, F.xxhash64("f1", "f2", "n_shingles", "doc_id")).otherwise(F.col("doc_id"))).drop("first")


def _members(classes: DataFrame) -> DataFrame:
    """(rep, key, leader) of the members of all band buckets that have several.

    Hot buckets, whose number is bounded by HOT_SHARE, are joined by broadcast, so that no task
    gets all rows of one.
    """
    key = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("signature", b * (2 * WIDTH) + 1, F.lit(2 * WIDTH))))
    bands = classes.select("rep", F.explode(key).alias("key"))
    buckets = stored(bands.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("size")).where("size > 1").select("key", "leader", "size"), "neardup-buckets")
    limit = max(HOT_LEAST, HOT_SHARE * BANDS * classes.count())
    hot = F.broadcast(buckets.where(F.col("size") > limit).select("key", "leader"))
    rest = bands.join(hot.select("key"), "key", "left_anti").join(buckets.where(F.col("size") <= limit).select("key", "leader"), "key")
    return bands.join(hot, "key").select("rep", "key", "leader").union(rest.select("rep", "key", "leader"))


def _judged(documents: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, kept) of each row of documents."""
    signed = stored(sign(documents, words), "neardup-signatures")
    classes = stored(_classes(signed), "neardup-classes")
    members = stored(_members(classes), "neardup-members")

    reps = stored(classes.select("rep", "doc_id", "text_hash").join(members.select("rep").distinct(), "rep", "left_semi"), "neardup-ids")
    texts = _identified(documents).join(F.broadcast(reps) if reps.count() <= BROADCAST_IDS else reps, ["doc_id", "text_hash"])
    texts = stored(texts.select("rep", "text").dropDuplicates(["rep"]), "neardup-texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        return stored(_confirmed(_promising(pairs, classes, percent), texts, words, percent), "neardup-links")

    links = confirmed(members.where("rep != leader").select(F.least("leader", "rep").alias("a"), F.greatest("leader", "rep").alias("b")).distinct())
    label = _labels(links)
    rows = _apart(members, label)
    found = confirmed(_of_small(rows))
    if not found.isEmpty():
        links = links.union(found)
        label = _labels(links)
        rows = _apart(members, label)
    if not rows.where(F.col("size") > SMALL).isEmpty():
        members = stored(_rare(rows, texts, words, percent), "neardup-rare")
        rows = _apart(members, label)
        found = confirmed(_of_small(rows).union(_stars(rows)).distinct())
        if not found.isEmpty():
            links = links.union(found)
            label = _labels(links)
            rows = _apart(members, label)
        if not rows.where(F.col("size") > SMALL).isEmpty():
            links = links.union(stored(_of_large(rows, classes, texts, words, percent), "neardup-links"))
            label = _labels(links)

    known = label.join(classes.select("rep", "doc_id"), "rep")
    smallest = known.groupBy("component").agg(F.min("doc_id").alias("smallest"))
    label = known.join(smallest, "component").select("rep", "smallest")
    joined = classes.join(label, "rep", "left").where("copies > 1 or smallest is not null")
    joined = joined.select("f1", "f2", "n_shingles", F.coalesce("smallest", "doc_id").alias("component"))
    out = signed.drop("signature").join(joined, ["f1", "f2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component")), "doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(documents: DataFrame, words: int = 3, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of documents(doc_id, text)."""
    return _judged(documents, words, percent).drop("text_hash")


def drop_near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """documents without the rows whose text's component has a smaller doc_id."""
    copy, copied = free_names(documents.columns, "copy", "copied")
    out = _judged(documents, words, percent).where("not kept").select(F.col("doc_id").alias(copy), F.col("text_hash").alias(copied)).distinct()
    return documents.join(_sized(out), (F.col("doc_id").cast("long") == F.col(copy)) & (F.xxhash64("text") == F.col(copied)), "left_anti")
