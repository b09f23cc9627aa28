"""Near-duplicates by a signature-coordinate inverted join.

1. Each text becomes its set of distinct word shingles and a MinHash signature.
   Equal sets are collapsed to one representative first, so copies cost nothing.
2. A set is posted under its (coordinate, value) pairs. Pairs are ordered by how
   many sets post them, rarest first: two sets that agree in at least
   ``matches`` coordinates share one of the first ``size - matches + 1``, so the
   others are skipped. What is common, as a passage that many documents share,
   is skipped first.
3. Posting lists are worked off in rounds. In a round every list has one hub (at
   first the set with most collisions), and its sets meet only that; of the hubs
   a set meets, the one with most collisions is tried. Pairs under the match
   threshold are dropped, the others confirmed on the full sets. Sets that are
   linked by now need no more tests among each other, so a group of thousands of
   near copies costs a pair per member, not per pair.
4. A last pass takes all pairs that are not linked yet and may still reach both
   thresholds, which the order of their shingles by frequency and the parity of
   their sketches tell without losing a link. It begins with rounds of hubs, too,
   now one by lot for each of a set's first shingles, so that a dense family is
   linked before its pairs are listed.
   Nothing is capped: every pair over the match threshold is confirmed, refuted,
   ruled out by such a bound, or known to be in one component.

``match_threshold`` sets the matches so that a pair at the similarity asked for
has fewer with a chance of about one in fifty million: 14 of 32 at 0.85.

Defined results: a null text counts as empty; a text without words is linked
with nothing; fewer words than a shingle has are one shingle; component_id is
the smallest doc_id of the component (null where all are null) and kept says
that doc_id is the same as it, so rows that repeat id and text share their fate;
an empty table gives an empty result; other columns are ignored by
``find_near_copies`` and kept by ``drop_near_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlake.llm.components import components, contract
from ledgerlake.llm.shingles import Shingler, Signer, texts_in_chunks
from ledgerlake.llm.sketch import passes_sketch
from ledgerlake.llm.tables import named, text_of, whole_row, written

SHINGLE_WORDS = 3
#: Linked when 100 * intersection >= SIMILARITY * union.
SIMILARITY = 85
COORDINATES = 32
HUB_ROUNDS = 2
#: Bits of the sketches by which pairs of the last pass are refuted.
PARITY_BITS = 512
#: Chance with which a pair at the very threshold may agree in too few coordinates.
MISSED = 2e-8

_SIGNED = "row long, doc_id long, t1 long, n long, f1 long, f2 long, coords array<int>"


def match_threshold(similarity: int, size: int = COORDINATES, missed: float = MISSED) -> int:
    """Most matches that a pair of this similarity reaches but with a chance of ``missed``."""
    p, below, matches = similarity / 100, 0.0, 0
    while matches < size:
        below += comb(size, matches) * p**matches * (1 - p) ** (size - matches)
        if below > missed:
            break
        matches += 1
    return max(matches, 1)


def _signer(words: int, size: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(words), Signer(size)
        for batch in batches:
            counts, fingerprints, coordinates = [], [], []
            for data, ends in texts_in_chunks(batch.column(3)):
                for found in shingler.sets(data, ends):
                    counts.append(len(found))
                    fingerprints.append((np.bitwise_xor.reduce(found), found.sum(dtype=np.uint64)))
                    coordinates.append(signer.sign(found))
            pairs = np.array(fingerprints, np.uint64).reshape(-1, 2).view(np.int64)
            flat = pa.array(np.concatenate(coordinates) if coordinates else np.zeros(0, np.int32), pa.int32())
            offsets = pa.array(np.arange(0, size * (len(counts) + 1), size), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(counts, pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.ListArray.from_arrays(offsets, flat)],
                ["row", "doc_id", "t1", "n", "f1", "f2", "coords"],
            )

    return sign


def _confirmer(words: int, similarity: int):
    """Of rows (a, b, text_a, text_b) those pairs whose full sets are similar enough."""

    def sets_of(shingler: Shingler, texts: pa.Array) -> list[np.ndarray]:
        return [found for data, ends in texts_in_chunks(texts) for found in shingler.sets(data, ends)]

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                a, b = some.column(0).to_numpy(), some.column(1).to_numpy()
                distinct, first, which = np.unique(b, return_index=True, return_inverse=True)
                right = sets_of(shingler, some.column(3).take(pa.array(first)))
                linked = []
                for left, w in zip(sets_of(shingler, some.column(2)), which.tolist()):
                    shared = len(np.intersect1d(left, right[w], assume_unique=True))
                    linked.append(100 * shared >= similarity * (len(left) + len(right[w]) - shared))
                linked = np.array(linked, bool)
                yield pa.RecordBatch.from_arrays([pa.array(a[linked]), pa.array(b[linked])], ["a", "b"])

    return confirm


def _key(doc_id: Column, t1: Column) -> Column:
    return F.xxhash64(doc_id, t1)


def _near_size(a: Column, b: Column, similarity: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * similarity


def postings(sets: DataFrame, matches: int) -> DataFrame:
    """(token, set_id, n, central, lead): each set under the (coordinate, value) pairs that others post, too.

    ``lead`` marks its rarest pairs, as many as the threshold needs to find all
    partners. ``central`` counts the set's collisions with all others.
    """
    coordinate = F.posexplode("coords").alias("c", "v")
    tokens = sets.select("set_id", "n", coordinate).select(
        "set_id", "n", F.shiftleft(F.col("c").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("token")
    )
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1")
    # Pairs that only one set posts are the rarest: they take the first places and need no list.
    ranked = tokens.join(shared, "token").groupBy("set_id", "n").agg(
        F.sort_array(F.collect_list(F.struct("sets", "token"))).alias("ranked"), F.sum("sets").alias("central")
    )
    enough = ranked.filter(F.size("ranked") >= matches).withColumn("leads", F.size("ranked") - (matches - 1))
    posted = enough.select(F.posexplode("ranked").alias("at", "r"), "set_id", "n", "central", "leads")
    return posted.select("r.token", "set_id", "n", "central", (F.col("at") < F.col("leads")).alias("lead"))


def _labelled(posts: DataFrame, edges: DataFrame | None) -> DataFrame:
    """Adds ``comp``: what a set is known to be linked with, as far as ``edges`` (a > b) show it."""
    if edges is None:
        return posts.withColumn("comp", F.col("set_id"))
    least = edges.groupBy(F.col("a").alias("set_id")).agg(F.min("b").alias("least"))
    return posts.join(least, "set_id", "left").withColumn("comp", F.coalesce("least", "set_id")).drop("least")


def _collisions(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds how many coordinates of a and b agree."""
    coords = sets.select("set_id", "coords")
    rows = pairs.join(coords.select(F.col("set_id").alias("a"), F.col("coords").alias("ca")), "a")
    rows = rows.join(coords.select(F.col("set_id").alias("b"), F.col("coords").alias("cb")), "b")
    same = F.size(F.filter(F.zip_with("ca", "cb", lambda x, y: x == y), lambda x: x))
    return rows.select("a", "b", same.alias("same"))


def _open_lists(rows: DataFrame, *hub: Column) -> DataFrame:
    """Lists that still hold sets not known to be linked."""
    lists = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), *hub)
    return lists.filter("lo < hi").drop("lo", "hi")


def _hub_pairs(rows: DataFrame, step: int, similarity: int) -> DataFrame:
    """(a, b): sets and their lists' hubs; first the set with most collisions is hub, then one by lot."""
    draw = -F.col("central") if step == 0 else F.xxhash64("set_id", F.lit(step))
    own = F.struct(draw.alias("draw"), F.col("set_id").alias("hub"), F.col("n").alias("hub_n"), F.col("comp").alias("hub_comp"))
    lists = _open_lists(rows, F.min(own).alias("hub")).select("token", "hub.*")
    met = rows.join(lists, "token").filter(F.col("comp") != F.col("hub_comp")).filter(_near_size(F.col("n"), F.col("hub_n"), similarity))
    return met.select(F.col("set_id").alias("a"), F.col("hub").alias("b")).distinct()


def _shingles_of(words: int):
    """(set_id, shingle, parity) of (set_id, text); only the first row of a set has its parity sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            number = 0
            for data, ends in texts_in_chunks(batch.column(1)):
                found = list(shingler.sets(data, ends))
                sizes = np.array([len(x) for x in found])
                owner = np.repeat(batch.column(0).to_numpy()[number : number + len(found)], sizes)
                number += len(found)
                parity = pa.array([parity_sketch(x) for x in found], pa.list_(pa.int64()))
                first = np.full(len(owner), -1)
                first[(np.cumsum(sizes) - sizes)[sizes > 0]] = np.flatnonzero(sizes)
                shown = parity.take(pa.array(first, mask=first < 0))
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.concatenate(found).view(np.int64)), shown], ["set_id", "shingle", "parity"])

    return run


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    """Bits that say whether an odd number of shingles fell on them.

    A shingle that both of two sets have cancels out of the difference of their
    sketches, so that cannot have more bits than the sets have shingles apart.
    """
    place = shingles >> np.uint64(64 - PARITY_BITS.bit_length() + 1)
    odd = np.bincount(place.astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _near_sketches(a: Column, b: Column, together: Column, similarity: int) -> Column:
    """Whether sketches allow the similarity: similar sets of ``together`` shingles have that many apart at most."""
    apart = sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(PARITY_BITS // 64)), F.lit(0))
    return apart * (100 + similarity) <= together * (100 - similarity)


def _first_shingles(rows: DataFrame, texts: DataFrame, words: int, similarity: int, matches: int) -> tuple[DataFrame, DataFrame]:
    """Lists of the sets that may still have a partner under their first shingles, and the texts of these sets.

    Only sets that post enough pairs together with sets of other components can
    have a partner. Of these the shingles are ordered, rarest first; similar
    sets share one of their first shingles, and where the first shared one
    stands (after ``at`` of n others) bounds what they share: at most
    m = min(n - at, n' - at'), so that their similarity is at most
    m / (n + n' - m). That bounds the size of a partner by ``lowest`` and ``highest``.
    """
    among = rows.join(_open_lists(rows), "token", "left_semi").groupBy("set_id", "n", "comp")
    open_sets = written(among.agg(F.count(F.lit(1)).alias("open")).filter(F.col("open") >= matches).drop("open"), "near-open")
    own = written(texts.join(open_sets.select("set_id"), "set_id").select("set_id", "text"), "near-own")
    shingles = written(own.mapInArrow(_shingles_of(words), "set_id long, shingle long, parity array<long>"), "near-shingles")
    sketched = open_sets.join(shingles.filter("parity IS NOT NULL").select("set_id", "parity"), "set_id")
    shared = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets"))
    rarest = Window.partitionBy("set_id").orderBy("sets", "shingle")
    first = shingles.select("set_id", "shingle").join(shared, "shingle").withColumn("at", F.row_number().over(rarest) - 1).join(sketched, "set_id")
    first = first.filter(f"sets > 1 AND at <= n - (n * {similarity} + 99) div 100").select("set_id", "shingle", "at", "n", "comp", "parity")
    share = similarity / (100 + similarity)
    lowest, highest = F.col("n") * similarity / 100, F.least(F.col("n") * 100 / similarity, (F.col("n") - F.col("at")) / share - F.col("n"))
    return written(first.withColumns({"lowest": lowest, "highest": highest}).filter("highest >= lowest - 1"), "near-first"), own


def _possible(similarity: int) -> Column:
    """Whether a set and its partner (``n2``, ``at2``, ``comp2``, ``parity2``) may be similar and are not known to be linked."""
    most_shared = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2"))
    possible = most_shared * 100 >= (F.col("n") + F.col("n2") - most_shared) * similarity
    near = _near_sketches(F.col("parity"), F.col("parity2"), F.col("n") + F.col("n2"), similarity)
    return (F.col("comp") != F.col("comp2")) & possible & near


def _shingle_hubs(first: DataFrame, step: int, similarity: int) -> DataFrame:
    """(a, b): sets and the hubs of their shingles' lists, one by lot for each list that is not linked yet."""
    partner = {"b": "set_id", "n2": "n", "at2": "at", "comp2": "comp", "parity2": "parity"}
    own = F.struct(F.xxhash64("set_id", F.lit(step)).alias("draw"), *[F.col(c).alias(name) for name, c in partner.items()])
    lists = first.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(own).alias("hub"))
    met = first.join(lists.filter("lo < hi").select("shingle", "hub.*"), "shingle").filter(_possible(similarity))
    return met.select(F.greatest("set_id", "b").alias("a"), F.least("set_id", "b").alias("b")).distinct()


def _remaining_pairs(first: DataFrame, similarity: int) -> DataFrame:
    """(a, b): all pairs that may reach both thresholds and are not known to be linked.

    Sets meet in their shingles' lists, in bands of admissible sizes. What meets
    is skipped unless the place of the shingle and the parity sketches allow the
    similarity; neither bound loses a link.
    """
    band = lambda size: F.floor(F.log(F.greatest(size, F.lit(1.0))) / F.lit(np.log(1.02)))
    lists = first.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    left = written(first.join(lists.select("shingle"), "shingle"), "near-left")
    wide = left.withColumn("band", F.explode(F.sequence(band(F.col("lowest") - 1), band(F.col("highest") + 1))))
    right = left.select(
        "shingle",
        band(F.col("n").cast("double")).alias("band"),
        F.col("set_id").alias("b"),
        F.col("n").alias("n2"),
        F.col("at").alias("at2"),
        F.col("comp").alias("comp2"),
        F.col("parity").alias("parity2"),
    )
    met = wide.join(right, ["shingle", "band"]).filter((F.col("set_id") < F.col("b")) & _possible(similarity))
    return met.select(F.col("set_id").alias("a"), "b").distinct()


def link_sets(
    sets: DataFrame, texts: DataFrame, posts: DataFrame, words: int, similarity: int, matches: int, rounds: int
) -> DataFrame | None:
    """(node, least) of linked sets; ``texts`` has (set_id, text) of all sets with postings."""

    def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("set_id").alias("a"), F.col("text").alias("text_a")), "a")
        both = both.join(texts.select(F.col("set_id").alias("b"), F.col("text").alias("text_b")), "b")
        return both.select("a", "b", "text_a", "text_b").mapInArrow(_confirmer(words, similarity), "a long, b long")

    def matching(pairs: DataFrame) -> DataFrame:
        """(a, b, same): pairs not tested so far that agree in enough coordinates."""
        if tested is not None:
            either = tested.unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
            pairs = pairs.join(either, ["a", "b"], "left_anti")
        return _collisions(pairs, sets).filter(F.col("same") >= matches)

    def linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        new = written(confirmed(pairs, texts), "near-links")
        return new if edges is None else edges.unionByName(new)

    edges = tested = None
    for step in range(rounds):
        rows = written(_labelled(posts, edges), "near-posts")
        found = matching(_hub_pairs(rows.filter("lead"), step, similarity))
        pairs = written(found.groupBy("a").agg(F.max_by("b", F.struct("same", "b")).alias("b")), "near-pairs")
        if pairs.isEmpty():
            continue
        tested = pairs if tested is None else written(tested.unionByName(pairs), "near-tested")
        edges = contract(linked(pairs, texts))
    if edges is not None:
        edges = _stars(edges)
    first, own = _first_shingles(written(_labelled(posts, edges), "near-posts"), texts, words, similarity, matches)
    for step in range(rounds):
        pairs = written(matching(_shingle_hubs(first, step, similarity)).select("a", "b"), "near-pairs")
        if pairs.isEmpty():
            break
        tested = pairs if tested is None else written(tested.unionByName(pairs), "near-tested")
        edges = _stars(linked(pairs, own))
        first = written(_labelled(first.drop("comp"), edges), "near-first")
    pairs = written(matching(_remaining_pairs(first, similarity)).select("a", "b"), "near-pairs")
    if not pairs.isEmpty():
        edges = _stars(linked(pairs, own))
    return None if edges is None else edges.select(F.col("a").alias("node"), F.col("b").alias("least"))


def _stars(edges: DataFrame) -> DataFrame:
    """(a, b): each linked set and the least of its component."""
    return components(edges).select(F.col("node").alias("a"), F.col("least").alias("b"))


def _clustered(
    docs: DataFrame,
    doc_id: str,
    text: str,
    words: int = SHINGLE_WORDS,
    similarity: int = SIMILARITY,
    size: int = COORDINATES,
    rounds: int = HUB_ROUNDS,
) -> DataFrame:
    """doc_id, t1 (hash of the text), n_shingles, component_id, kept."""
    matches = match_threshold(similarity, size)
    plain = docs.select(named(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).withColumn("t1", F.xxhash64("text"))
    ordered = plain.select(F.monotonically_increasing_id().alias("row"), "doc_id", "t1", "text")
    signed = written(ordered.mapInArrow(_signer(words, size), _SIGNED), "near-signed")
    sets = (
        signed.filter("n > 0")
        .groupBy("n", "f1", "f2")
        .agg(F.min(F.struct("row", "doc_id", "t1", "coords")).alias("rep"), F.min("doc_id").alias("least_id"))
        .select("n", "f1", "f2", "least_id", F.col("rep.row").alias("set_id"), "rep.doc_id", "rep.t1", "rep.coords")
    )
    sets = written(sets, "near-sets")
    posts = written(postings(sets, matches), "near-postings")
    wanted = posts.select("set_id").distinct().join(sets.select("set_id", "doc_id", "t1"), "set_id")
    wanted = written(wanted.withColumn("key", _key(F.col("doc_id"), F.col("t1"))), "near-wanted")
    routed = passes_sketch(plain.withColumn("key", _key(F.col("doc_id"), F.col("t1"))), wanted.select("key"), "key").filter("routed")
    texts = written(routed.select("key", "text").join(wanted.select("key", "set_id"), "key").select("set_id", "text"), "near-texts")
    if texts.count() > wanted.count():  # rows that repeat both id and text
        texts = written(texts.dropDuplicates(["set_id"]), "near-texts")
    stars = link_sets(sets, texts, posts, words, similarity, matches, rounds)
    known = sets.select("n", "f1", "f2", "set_id", "least_id")
    if stars is not None:
        known = known.join(stars.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("comp", F.coalesce("least", "set_id"))
        least = known.groupBy("comp").agg(F.min("least_id").alias("component_id"))
        known = known.join(least, "comp")
    else:
        known = known.withColumn("component_id", F.col("least_id"))
    known = written(known.select("n", "f1", "f2", "component_id", F.lit(True).alias("known")), "near-known")
    rows = signed.select("doc_id", "t1", "n", "f1", "f2").join(known, ["n", "f1", "f2"], "left")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id"))
    rows = rows.select("doc_id", "t1", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def find_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    return _clustered(docs, doc_id, text, **options).drop("t1")


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows that stay, with all their columns; only what may have to go is shuffled."""
    gone = _clustered(docs, doc_id, text, **options).filter("NOT kept")
    gone = written(gone.select(_key(F.col("doc_id"), F.col("t1")).alias("key"), "doc_id", "t1").distinct(), "near-gone")
    row = F.col("row")
    rows = docs.select(whole_row(docs).alias("row")).withColumn("_id", row.getField(doc_id).cast("long"))
    rows = rows.withColumn("_t1", F.xxhash64(F.coalesce(row.getField(text).cast("string"), F.lit(""))))
    rows = passes_sketch(rows.withColumn("key", _key(F.col("_id"), F.col("_t1"))), gone.select("key"), "key")
    cleared = rows.filter("routed").join(
        gone.select("key", "doc_id", "t1"),
        (rows["key"] == gone["key"]) & F.col("_id").eqNullSafe(gone["doc_id"]) & (F.col("_t1") == gone["t1"]),
        "left_anti",
    )
    return rows.filter("NOT routed").select("row").unionByName(cleared.select("row")).select("row.*")
