"""Near-duplicate detection by min-max hashing.

Each of ``PERMUTATIONS`` hash functions of a shingle set keeps both its minimum and its
maximum; either is shared by two sets with a probability equal to their Jaccard
similarity, so half the hash evaluations give a signature of full length, and of lower
variance. The signature is cut into bands of ``ROWS`` values; documents that share a
band are candidates, and every link is confirmed on the full sets.

Scale. Documents with equal sets are one vertex from the start. In a band, all members
are first compared with one centre of other component, then with other centres, so large
groups of copies cost about one comparison a member. Members of bands that this leaves
in several components meet by a prefix filter: each set's shingles are put in order of
rising count, and two sets of similarity 0.8 share one among the first few of both, of
which few there are the fewer the more alike the sizes are. Documents that differ by
shingles of their own have those in front and don't meet, so work follows the links and
not the square of a group, and no link between components is lost: at similarity 0.8,
two documents share no band with a probability of 3e-6.

Edge cases: null or empty texts, or those without words, have an empty set and are
linked with nothing; a single word is a set of one; rows of one id count as one
document, and are linked; rows without an id are linked with nothing and kept; an empty
table gives an empty result; a long text is hashed whole, alone in its chunk; other
columns travel under names of their own, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varispark.llm.chunks import Chunk, Chunks, mix, pack_chunks, read_chunks, split_words, window_hash, with_replies
from varispark.llm.components import connected_components
from varispark.session import materialise, release_memory

PERMUTATIONS = 80
ROWS = 5
#: Rounds of comparing the members of a band with one centre, before those still apart meet by the prefix filter.
TURNS = 3
#: Sizes within about this share of each other form a bucket of the prefix filter.
_SIZE_STEP = 0.03
_RNG = np.random.default_rng(977)
_A = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_MULTIPLIER = 0x9FB21C651E98DF25


def _shingles(c: Chunk, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents, with their counts and first places."""
    w = split_words(c, lower=True)
    h = window_hash(w.hashes, k, _MULTIPLIER)
    inside = np.flatnonzero(w.doc[: len(h)] == w.doc[k - 1 :]) if len(h) else np.zeros(0, np.int64)
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    first = np.append(0, np.cumsum(w.counts))
    whole = np.array([_sequence(w.hashes[first[d] : first[d + 1]], k) for d in short], np.uint64)
    h, doc = np.concatenate([h[inside], whole]), np.concatenate([w.doc[inside], short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])) if len(h) else np.zeros(0, bool)
    h, doc = h[new], doc[new]
    counts = np.bincount(doc, minlength=len(c))
    return h, counts, np.append(0, np.cumsum(counts))


def _sequence(hashes: np.ndarray, k: int) -> np.uint64:
    """A whole document of fewer than k words as one shingle."""
    h = np.array([k * 31 + len(hashes)], np.uint64)
    for x in hashes:
        h = mix(h * np.uint64(_MULTIPLIER) + x)
    return h[0]


def _signatures(c: Chunk, k: int) -> pa.RecordBatch:
    h, counts, first = _shingles(c, k)
    full = np.flatnonzero(counts)
    at = first[:-1][full]
    sums = np.zeros((2, len(c)), np.uint64)
    bands = np.zeros((len(full), 2 * PERMUTATIONS // ROWS), np.uint64)
    if len(full):
        sums[0, full] = np.add.reduceat(mix(h ^ np.uint64(0x51ED270B35A1F0C3)), at)
        sums[1, full] = np.add.reduceat(mix(h + np.uint64(0x2545F4914F6CDD1D)), at)
        values = np.empty((2 * PERMUTATIONS, len(full)), np.uint64)
        for i in range(PERMUTATIONS):
            v = (h * _A[i] + _B[i]) >> np.uint64(32)
            values[i] = np.minimum.reduceat(v, at)
            values[PERMUTATIONS + i] = np.maximum.reduceat(v, at)
        for b in range(bands.shape[1]):
            key = np.full(len(full), b + 1, np.uint64)
            for r in range(ROWS):
                key = mix(key * np.uint64(_MULTIPLIER) + values[b * ROWS + r])
            bands[:, b] = key
    sizes = np.zeros(len(c), np.int64)
    sizes[full] = bands.shape[1]
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(bands.ravel().view(np.int64)))
    n = len(c)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, c.chunk_id), pa.int64()), pa.array(np.arange(n), pa.int32()), c.id_array, pa.array(counts, pa.int64()), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), lists], ["chunk_id", "place", "doc_id", "n_shingles", "s1", "s2", "bands"])


_SIGNATURE_SCHEMA = "chunk_id bigint, place int, doc_id bigint, n_shingles bigint, s1 bigint, s2 bigint, bands array<bigint>"


def _confirm(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose sets are similar enough."""
    right = edges.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    both = right.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = []
            for x, y in zip(t.column("sa"), t.column("sb"), strict=True):
                x, y = (np.asarray(z.values).view(np.uint64) for z in (x, y))
                both = _common(x, y)
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([t.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(check, "a bigint, b bigint")


def _prefix_pairs(state: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``state`` (id, n, component) in different components that may be linked: no link is missed.

    A pair's overlap must reach percent * (na + nb) / (100 + percent). If the first
    shingle that both have, in the common order, stands at places i and j, the overlap is at
    most min(na - i, nb - j). So the smaller set is entered under its places up to the
    bound for an equal partner, and the larger one asks under its places up to the
    bound for the least size in each bucket of sizes.
    """
    need = lambda x, y: F.ceil((x + y) * percent / F.lit(100.0 + percent) - F.lit(1e-9))
    bucket = lambda x: F.floor(F.ln(x.cast("double")) / _SIZE_STEP).cast("int")
    n, items = F.col("n"), F.col("items")
    least = F.ceil(n * percent / F.lit(100.0) - F.lit(1e-9))
    tokens = sets.join(state, "id").select("id", "n", "component", F.explode("shingles").alias("s"))
    common = tokens.groupBy("s").agg(F.count("*").alias("c")).where("c > 1")
    # shingles of one set alone come first; they are counted, not listed
    lists = tokens.join(common, "s").groupBy("id", "n", "component").agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("t"))
    lists = lists.withColumn("own", n - F.size("t")).withColumn("room", n - least + 1 - F.col("own")).where("room > 0")
    lists = materialise(lists.select("id", "n", "component", "own", F.transform(F.slice("t", 1, F.col("room").cast("int")), lambda x: x["s"]).alias("items")))
    entered = lists.select("id", "n", "component", bucket(n).alias("bucket"), F.posexplode(F.slice(items, 1, F.greatest(F.lit(0), n - need(n, n) + 1 - F.col("own")).cast("int"))).alias("i", "s"), "own")
    asked = lists.select("id", "n", "component", "own", "items", F.explode(F.sequence(bucket(least), bucket(n))).alias("bucket"))
    low = F.greatest(least, F.floor(F.exp(F.col("bucket") * _SIZE_STEP)) - 1)
    asked = asked.select("id", "n", "component", "own", "bucket", F.posexplode(F.slice(items, 1, F.greatest(F.lit(0), n - need(n, low) + 1 - F.col("own")).cast("int"))).alias("i", "s"))
    x = entered.select("s", "bucket", F.col("id").alias("ia"), F.col("n").alias("na"), F.col("component").alias("ca"), (F.col("n") - F.col("own") - F.col("i")).alias("ra"))
    y = asked.select("s", "bucket", F.col("id").alias("ib"), F.col("n").alias("nb"), F.col("component").alias("cb"), (F.col("n") - F.col("own") - F.col("i")).alias("rb"))
    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("ia") < F.col("ib")))
    met = x.join(y, ["s", "bucket"]).where(smaller & (F.col("ca") != F.col("cb"))).where(F.expr(f"least(ra, rb) * {100 + percent} >= {percent} * (na + nb)"))
    return met.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b")).distinct()


def _common(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int(np.count_nonzero(y[at] == x))


class NearDuplicates:
    """Signatures, links and components of a table of documents."""

    def __init__(self, docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", carry: bool = True):
        self.words, self.percent = words, percent
        self.chunks: Chunks = pack_chunks(docs, id_col, text_col, carry=carry)

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for c in read_chunks(b):
                    yield _signatures(c, words)
            release_memory()

        self.signatures = materialise(self.chunks.table.mapInArrow(sign, _SIGNATURE_SCHEMA))
        with_set = self.signatures.where("n_shingles > 0 and doc_id is not null")
        self.classes = materialise(with_set.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "n_shingles", "chunk_id", "place", "bands")).alias("r")).select("s1", "s2", F.col("r.doc_id").alias("id"), F.col("r.n_shingles").alias("n"), "r.chunk_id", "r.place", "r.bands"))
        self.components = self._link()

    def _link(self) -> DataFrame:
        """(id, component) for every class that shares a band with another one."""
        rows = self.classes.select("id", "n", "chunk_id", "place", F.explode("bands").alias("band"))
        shared = rows.groupBy("band").agg(F.count("*").alias("k")).where("k > 1").select("band")
        members = materialise(rows.join(shared, "band"))
        wanted = members.select("chunk_id", F.col("place").alias("bucket"), F.lit(None).cast("binary").alias("payload")).distinct()
        k = self.words

        def sets_of(c: Chunk, got: list[tuple[int, bytes]]) -> pa.Table:
            at = np.array(sorted(p for p, _ in got), np.int64)
            if not len(at):
                return pa.table({"id": pa.array([], pa.int64()), "shingles": pa.array([], pa.list_(pa.int64()))})
            h, counts, first = _shingles(c, k)
            values = np.concatenate([h[first[p] : first[p + 1]] for p in at]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts[at])), pa.int32()), pa.array(values))
            return pa.table({"id": c.id_array.take(pa.array(at)), "shingles": lists})

        sets = materialise(with_replies(self.chunks, wanted, sets_of, "id bigint, shingles array<bigint>"))
        state = members.select("id", "n").distinct().withColumn("component", F.col("id"))
        members = members.select("band", "id")
        similar_size = F.expr(f"100 * least(na, nb) >= {self.percent} * greatest(na, nb)")
        for turn in range(TURNS):
            now = members.join(state, "id")
            # the first centre of a band is its smallest id, later ones are others
            by = F.struct(F.xxhash64("id", F.lit(turn)), "id") if turn else F.struct("id")
            centre = now.groupBy("band").agg(F.min_by(F.struct("id", "n", "component"), by).alias("c"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
            centre = centre.select("band", F.col("c.id").alias("a"), F.col("c.n").alias("na"), F.col("c.component").alias("ca"))
            pairs = now.select("band", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb")).join(centre, "band").where("ca <> cb").where(similar_size)
            pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            state = self._merge(state, _confirm(pairs, sets, self.percent))
        now = members.join(state, "id")
        apart = now.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band")
        rest = now.join(apart, "band").select("id", "n", "component").distinct()
        return self._merge(state, _confirm(_prefix_pairs(rest, sets, self.percent), sets, self.percent)).select("id", "component")

    def _merge(self, state: DataFrame, links: DataFrame) -> DataFrame:
        """``state`` with the components that ``links`` (a, b) join; the graph of components alone is walked."""
        of = state.select("id", "component")
        ends = links.join(of.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a").join(of.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b")
        roots = connected_components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        roots = roots.select(F.col("id").alias("component"), F.col("component").alias("root"))
        return materialise(state.join(roots, "component", "left").select("id", "n", F.coalesce("root", "component").alias("component")))

    def result(self) -> DataFrame:
        """One row per document: doc_id, n_shingles, component_id, kept."""
        of_class = self.classes.select("s1", "s2", "id").join(self.components, "id", "left").select("s1", "s2", F.coalesce("component", "id").alias("c"))
        rows = self.signatures.select("chunk_id", "place", "doc_id", "n_shingles", "s1", "s2").join(of_class, ["s1", "s2"], "left")
        found = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("c")).otherwise(F.col("doc_id"))
        return rows.select("chunk_id", "place", "doc_id", "n_shingles", found.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

    def kept_documents(self) -> DataFrame:
        """The documents that stay, with all their columns; of repeated rows of one id one stays."""
        once = Window.partitionBy("doc_id").orderBy("chunk_id", "place")
        kept = self.result().where("kept")
        stay = kept.where("doc_id is not null").withColumn("turn", F.row_number().over(once)).where("turn = 1").select("chunk_id", "place")
        stay = stay.unionByName(kept.where("doc_id is null").select("chunk_id", "place"))
        replies = stay.select("chunk_id", F.col("place").alias("bucket"), F.lit(None).cast("binary").alias("payload"))

        def take(c: Chunk, got: list[tuple[int, bytes]]) -> pa.Table:
            at = pa.array(sorted(p for p, _ in got), pa.int32())
            return pa.table({"doc_id": c.id_array.take(at), "text": c.texts.take(at), "rest": c.rest.take(at)})

        kind = self.chunks.table.schema["rest"].dataType.elementType.simpleString()
        out = with_replies(self.chunks, replies, take, f"doc_id bigint, text binary, rest {kind}")
        return out.select("doc_id", F.col("text").cast("string").alias("text"), *[F.col("rest")[f"c{i}"].alias(n) for i, n in enumerate(self.chunks.rest)])


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable), kept."""
    return NearDuplicates(docs.select("doc_id", "text"), words, percent, carry=False).result().drop("chunk_id", "place")
